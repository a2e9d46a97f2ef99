"""Plain Python versions of the span and window operators, written from their contracts."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d >= 5 else 2 * d)
    return total % 10 == 0


def pii(text):
    text = text or ""
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    spans = [(k, s, e) for k, v in found.items() for s, e in v]
    return {**{f"n_{k}": len(v) for k, v in found.items()}, "base_sha256": digest(spans)}


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
        r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text
    ):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 16:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 32:
            found.append((m.start(), 2, "hex", m.end()))
    found.sort()
    count = lambda kind: sum(f[2] == kind for f in found)
    return {
        "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
        "base_sha256": digest([(k, s, e) for s, _, k, e in found]),
    }


def contamination(documents, benchmark, size=10):
    words = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)
    )
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in documents:
        w, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        items = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(w), len(hit), len(items),
                    hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    return out
