"""Declarations found by grammar, on texts written for these tests."""

from test_text import MORE, SOURCE, declared

from seqset.sources import grammar

SPREAD = """<html> class No {} <?php
// class Hidden { function a() {}
namespace Yard\\Tools; # class Hidden2 {}
/* interface Hidden3 {
   function b(); } */
#[Tool(kind: 'class Hidden4 {')]
final
  class // the name follows
  Crane extends Machine
  implements Lifts
{
  use Loads;
  const MAX = 5;
  #[Inject]
  public
    static ?Rope $rope = [1, 2,
      '$no'], $hook,
    $chain = null;
  private readonly int|string $weight;
  abstract protected function
    reach(
      public int $metres,
      $how = self::MAX,
    ): ?array;
  function &class() { $x = "{$y} }"; static $z = 1; function inner() {} return new class { public $anon; function anon() {} }; }
  public function each(callable $f) { $this->function($f); return Crane::class; }
}
function
 load($f = 1) { return array_map(function ($x) { return $x; }, $f); }
$text = <<<END
class Hidden5 { public $q; }
  END;
interface Lifts { const A = 1;
  public function up(); }
trait Loads { public $t; function t() {} }
?> class Hidden6 {} <?php
if (true) { function cond() {} }
namespace Other { class Inside { var $speed } function deep() {} }
namespace { function bare() {} }
"""


def found(spark, *sources):
    df = spark.createDataFrame([(f"f{i}.php", s) for i, s in enumerate(sources)], "path string, text string")
    return grammar.source_declarations(df, "path", "text")


def test_declarations_over_several_lines(spark):
    at = lambda piece: SPREAD.index(piece) + 1
    line = lambda piece: SPREAD[: SPREAD.index(piece)].count("\n") + 1
    rows = found(spark, SPREAD).orderBy("offset", "name").collect()
    crane = "Yard\\Tools\\Crane"
    want = [
        ("class", f"{crane}", "  Crane", "final"),
        ("property", f"{crane}$chain", "    $chain", "public\n    static"),
        ("property", f"{crane}$hook", "      '$no'], $hook", "public\n    static"),
        ("property", f"{crane}$rope", "    static ?Rope $rope", "public\n    static"),
        ("property", f"{crane}$weight", "  private readonly int|string $weight", "private readonly"),
        ("method", f"{crane}:reach", "    reach", "abstract protected"),
        ("method", f"{crane}:class", "  function &class", "function &class"),
        ("method", f"{crane}:each", "  public function each", "public function each"),
        ("function", "Yard\\Tools\\load", " load", "function\n load"),
        ("interface", "Yard\\Tools\\Lifts", "interface Lifts", "interface Lifts"),
        ("method", "Yard\\Tools\\Lifts:up", "  public function up", "public function up"),
        ("function", "Yard\\Tools\\cond", "if (true) { function cond", "function cond"),
        ("class", "Other\\Inside", "namespace Other { class Inside", "class Inside"),
        ("property", "Other\\Inside$speed", "namespace Other { class Inside { var $speed", "var $speed"),
        ("function", "Other\\deep", "namespace Other { class Inside { var $speed } function deep", "function deep"),
        ("function", "\\bare", "namespace { function bare", "function bare"),
    ]
    assert [(r["kind"], r["full_name"], r["prefix"], r["line"], r["offset"]) for r in rows] == [
        (kind, name, prefix, line(piece), at(piece)) for kind, name, prefix, piece in want
    ]


def test_as_line_patterns_where_each_stands_on_a_line(spark):
    """The same rows as the reader by lines, but for the kind of methods and functions inside functions."""
    columns = ["path", "n_chars", "scope", "owner", "name", "full_name", "prefix", "line", "offset"]
    both = [sorted(map(str, df.select(columns).collect())) for df in (found(spark, SOURCE, MORE), declared(spark, SOURCE, MORE))]
    assert both[0] == both[1] and len(both[0]) == 17


def test_odd_texts(spark):
    texts = [None, "", " ", "class", "class A", "}}} class B { public $x", "function f(", "class C\r\n{\r\n  var\r\n $d;\r\n}", "'class D {}", "é class É1 { }",
             "'" + "\\'" * 50_000 + "' class E {}", "// " + "?" * 50_000 + "\nclass G {}", "{" * 5_000 + "class H {}"]
    rows = found(spark, *texts).collect()
    assert sorted((r["path"], r["full_name"], r["line"], r["offset"]) for r in rows) == sorted([
        ("f4.php", "\\A", 1, 1), ("f5.php", "\\B", 1, 5), ("f5.php", "B$x", 1, 15), ("f6.php", "\\f", 1, 1), ("f7.php", "\\C", 1, 1), ("f7.php", "C$d", 3, 15),
        ("f8.php", "\\D", 1, 2), ("f9.php", "\\É1", 1, 3), ("f10.php", "\\E", 1, 100_004), ("f11.php", "\\G", 2, 50_005), ("f12.php", "\\H", 1, 5_001),
    ])
    assert found(spark, "x").filter("false").count() == 0
