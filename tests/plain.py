"""The operators on one sequence, as plain loops over (pos, kind) lists."""

from __future__ import annotations

from itertools import product


def extract(kinds, start, stop, keep_start, keep_stop):
    out, opened = [], False
    for i, k in enumerate(kinds):
        if k in start:
            opened = True
            if keep_start:
                out.append(i)
        elif opened and k in stop:
            if keep_stop:
                out.append(i)
            break
        elif opened:
            out.append(i)
    return out


def spans(kinds, pairs):
    """For each opener the place of its closer, or None."""
    out, stack = {}, []
    for i, k in enumerate(kinds):
        if k in pairs:
            out[i] = None
            stack.append(i)
        elif stack and pairs[kinds[stack[-1]]] == k:
            out[stack.pop()] = i
    return out


def records(kinds, delimiters, opener, closer):
    out, record, depth = [], 1, 0
    for k in kinds:
        if k == opener:
            depth += 1
        elif k == closer:
            depth = max(0, depth - 1)
        out.append(record)
        if k in delimiters and depth == 0:
            record += 1
    return out


def dropped(kinds, start, end):
    out, inside = [], False
    for i, k in enumerate(kinds):
        if k in start:
            inside = True
        elif inside:
            if k in end:
                inside = False
        else:
            out.append(i)
    return out


def sections(kinds, markers, head=None):
    out, current, seen = [], None, set()
    for i, k in enumerate(kinds):
        if i == 0 and head and k == head[1]:
            current = head[0]
        for name, marker in markers.items():
            if name not in seen and list(kinds[i : i + len(marker)]) == list(marker):
                current = name
                seen.add(name)
        out.append(current)
    return out


def marked(kinds, opener, closer, marker):
    """(start, end, depth, parent) of the spans that begin with the marker."""
    chosen = [(s, e) for s, e in spans(kinds, {opener: closer}).items() if s + 1 < len(kinds) and kinds[s + 1] == marker]
    out = []
    for s, e in chosen:
        around = [a for a, b in chosen if a < s and (b is None or b > s)]
        out.append((s, e, len(around) + 1, max(around, default=None)))
    return sorted(out)


def covers(items, holders):
    lists = [holders[i] for i in set(items) if holders.get(i)]
    return {tuple(sorted(set(pick))) for pick in product(*lists)} if lists else set()
