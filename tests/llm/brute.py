"""Plain versions of the operators for small inputs, and rows with awkward values."""

import base64
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    turned = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(turned)) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in p.finditer(text or "") if ok(m.group())] for k, (p, ok) in rules.items()}


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def components(rows):
    """doc_id -> smallest doc_id reachable, for (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def awkward_texts(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß漢") for _ in range(rnd.randint(1, 6)))
    long = " ".join(word() for _ in range(6000))
    base = [word() for _ in range(60)]
    near = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in (3, 20, 40)]
    chain = [" ".join(base[:50] + [word() for _ in range(n)]) for n in (2, 4, 6)]
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "ONE", "one two", "Two  words", long, long, long + " end", " ".join(base), *near, *chain,
        "a b c d e a b c d e f g", "line\nline\n\n\nline \nother", "x" * 5000, "no break space", "\x1c\x1d sep", "🙂 🙂 🙂 🙂 🙂 🙂", "#*$%&|<> ##",
        "A B C D E F G H I J K L", "a b c d e f g h i j k l", "1 2 3 4 5 6 7 8 9 10 11 12",
    ]
