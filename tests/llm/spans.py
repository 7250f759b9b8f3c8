"""Plain-Python forms of the base span rules."""
import hashlib
import re

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def spans(pattern, text, fits):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text) if fits(m)]


def secrets(t):
    return [spans(ASSIGN, t, lambda m: len(m.group(2)) >= 6), spans(r"AKIA[A-Z0-9]+", t, lambda m: len(m.group()) >= 20),
            spans(r"[0-9a-f]+", t, lambda m: len(m.group()) >= 24)]


def personal(t):
    return [spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, lambda m: True),
            spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(x) <= 255 for x in m.group().split("."))),
            spans(r"[0-9]([\x20-]?[0-9])+", t, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
            spans(r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 9 <= len(digits(m)) <= 15)]


def digest(text, find, kinds):
    """Counts per kind, and the digest of the span string."""
    found = find(text or "")
    order = sorted((s, i, e, k) for i, (k, part) in enumerate(zip(kinds, found)) for s, e in part)
    line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in order)
    return (*map(len, found), hashlib.sha256(line.encode()).hexdigest(), line)
