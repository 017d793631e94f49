"""Metaphone and NYSIIS as loops over one word: what the tables of functions/phonetics.py are held against."""

from __future__ import annotations

import re


def metaphone(word: str) -> str:
    """Philips' Metaphone (1990) of lower-case letters."""
    w = re.sub("[^a-z]", "", word)
    w = re.sub(r"^(?:kn|gn|pn|ae|wr)", lambda m: m[0][1], w)
    w = re.sub("^x", "s", w)
    w = re.sub("^wh", "w", w)
    w = re.sub(r"([^c])\1+", r"\1", w)
    out, n, i = "", len(w), 0
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, nxt, step = w[i], at(i + 1), 1
        front = nxt and nxt in "eiy"
        if c in "aeiou":
            out += c if i == 0 else ""
        elif c == "b":
            out += "" if i == n - 1 and at(i - 1) == "m" else "b"
        elif c == "c":
            if front:
                out += "" if at(i - 1) == "s" else ("x" if nxt == "i" and at(i + 2) == "a" else "s")
            elif nxt == "h":
                out += "k" if at(i - 1) == "s" else "x"
                step = 2
            else:
                out += "k"
        elif c == "d":
            out += "j" if nxt == "g" and at(i + 2) in tuple("eiy") else "t"
            step = 2 if out.endswith("j") else 1
        elif c == "g":
            if nxt == "h":
                out += "" if i + 2 < n and at(i + 2) not in tuple("aeiou") else ("f" if i and i + 2 == n else ("" if i else "k"))
                step = 2
            elif nxt == "n":
                out += "" if i + 2 >= n or w[i + 1 :] == "ned" else "k"
            else:
                out += "j" if front else "k"
        elif c == "h":
            out += "h" if nxt in tuple("aeiou") and at(i - 1) not in tuple("csptg") else ""
        elif c == "k":
            out += "" if at(i - 1) == "c" else "k"
        elif c == "p":
            out += "f" if nxt == "h" else "p"
            step = 2 if nxt == "h" else 1
        elif c == "q":
            out += "k"
        elif c == "s":
            if nxt == "h" or (nxt == "i" and at(i + 2) in tuple("oa")):
                out += "x"
                step = 2 if nxt == "h" else 1
            else:
                out += "s"
        elif c == "t":
            if nxt == "i" and at(i + 2) in tuple("oa"):
                out += "x"
            elif nxt == "h":
                out += "t" if at(i + 2) == "m" else "0"
                step = 2
            else:
                out += "" if nxt == "c" and at(i + 2) == "h" else "t"
        elif c == "v":
            out += "f"
        elif c in "wy":
            out += c if nxt in tuple("aeiou") else ""
        elif c == "x":
            out += "ks"
        elif c == "z":
            out += "s"
        else:
            out += c
        i += step
    return out.upper()


def nysiis(word: str) -> str:
    """The New York State Identification and Intelligence System code of lower-case letters."""
    w = re.sub("[^a-z]", "", word)
    if not w:
        return ""
    for a, b in (("mac", "mcc"), ("kn", "nn"), ("k", "c"), ("ph", "ff"), ("pf", "ff"), ("sch", "sss")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    for a, b in (("ee", "y"), ("ie", "y"), ("dt", "d"), ("rt", "d"), ("rd", "d"), ("nt", "d"), ("nd", "d")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    out, i = w[0], 1
    while i < len(w):
        c, new, step = w[i], w[i], 1
        if w[i : i + 2] == "ev":
            new, step = "af", 2
        elif c in "aeiou":
            new = "a"
        elif c == "q":
            new = "g"
        elif c == "z":
            new = "s"
        elif c == "m":
            new = "n"
        elif w[i : i + 2] == "kn":
            new, step = "n", 2
        elif c == "k":
            new = "c"
        elif w[i : i + 3] == "sch":
            new, step = "sss", 3
        elif w[i : i + 2] == "ph":
            new, step = "ff", 2
        elif c == "h" and (w[i - 1] not in "aeiou" or (i + 1 < len(w) and w[i + 1] not in "aeiou") or i + 1 == len(w)):
            new = out[-1]
        elif c == "w" and w[i - 1] in "aeiou":
            new = out[-1]
        for x in new:
            if x != out[-1]:
                out += x
        i += step
    if len(out) > 1 and out.endswith("s"):
        out = out[:-1]
    if out.endswith("ay"):
        out = out[:-2] + "y"
    if len(out) > 1 and out.endswith("a"):
        out = out[:-1]
    return out.upper()
