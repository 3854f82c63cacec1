"""Small plain models of what verification means, to compare the jobs with."""

import re

from veilwork.functions import rules


def clamp_round(x):
    return round(min(0.99, max(0.01, x)), 4)


def matches(text, found=rules.CORE):
    return sum(len(re.findall(r.pattern, text)) for r in found)


def walk(value, path=""):
    """Every ``(path, value, is a key)`` below a value."""
    if isinstance(value, dict):
        for name, child in value.items():
            at = f"{path}.{name}" if path else name
            yield at, child, True
            yield from walk(child, at)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield f"{path}[{i}]", child, False
            yield from walk(child, f"{path}[{i}]")


def leaves(doc):
    return [("", doc)] if isinstance(doc, str) else [(p, v) for p, v, _ in walk(doc) if isinstance(v, str)]


def key_paths(doc):
    return {p for p, _, is_key in walk(doc) if is_key}


def find(doc, path):
    """The string a path leads to, read as dotted names and bracketed or bare numbers."""
    for name in filter(None, re.sub(r"\[(\d+)\]", r".\1.", path).split(".")):
        if name.isdigit():
            doc = doc[int(name)] if isinstance(doc, list) and int(name) < len(doc) else None
        else:
            doc = doc.get(name) if isinstance(doc, dict) else None
    return doc if isinstance(doc, str) else None


def removal(base, cand):
    return max(0.0, 1 - cand / base) if base else 1.0


def grade_json(base, cand):
    gone = removal(sum(matches(v) for _, v in leaves(base)), sum(matches(v) for _, v in leaves(cand)))
    names = key_paths(base)
    kept_names = len(names & key_paths(cand)) / len(names) if names else 1.0
    clean = [(p, v) for p, v in leaves(base) if not matches(v)]
    same = [p for p, v in clean if (there := find(cand, p)) is not None and there.strip() == v.strip()]
    kept = len(same) / len(clean) if clean else 1.0
    return gone, kept_names, kept, clamp_round(0.4 * gone + 0.25 * kept_names + 0.25 * kept + 0.1)


def grade_text(base, cand):
    lines = [[x for x in t.splitlines() if x.strip()] for t in (base, cand)]
    gone = removal(matches(base, rules.SSN_ONLY), matches(cand, rules.SSN_ONLY))
    formatted = sum(bool(re.match(rules.CHAT_LINE_PATTERN, x)) for x in lines[1])
    shape = 0.5 * (len(lines[0]) == len(lines[1])) + 0.5 * formatted / len(lines[0]) if lines[0] else 0.0
    tokens = {m if isinstance(m, str) else m[0] for t in rules.TOKENS for m in re.findall(t.pattern, base)}
    kept = sum(t in cand for t in tokens) / len(tokens) if tokens else 1.0
    return clamp_round(0.5 * gone + 0.25 * shape + 0.25 * kept)


def grade_rows(base, cand, protected):
    count = lambda rows: sum(matches(c, rules.CARD_TABLE) for r in rows for c in r.values())
    gone, shape = removal(count(base), count(cand)), float(len(base) == len(cand))
    compared = [(b[c].strip(), d.get(c, "").strip()) for b, d in zip(base, cand, strict=False) for c in protected]
    kept = 0.0 if not base or not cand else sum(x == y for x, y in compared) / len(compared) if compared else 1.0
    return clamp_round(0.5 * gone + 0.25 * shape + 0.25 * kept)
