"""Small tables and plain restatements of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and of to in that it is was for on are with".split(), "fr": "le la les de des et en un une dans pour que é ê".split(), "de": "der die das und ist nicht ein eine mit auf ü ß".split()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n=60, lang="en"):
    r = random.Random(seed)
    s = SYLLABLES[lang]
    out = ["".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(out))


def edited(text, seed, changes):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def documents():
    """Copies, near copies at all distances, shared passages, shared lines, empty, null, very long and very short texts,
    repeated rows, a null id."""
    rows = []
    for k in range(30):
        rows.append(prose(k, 20 + 7 * k, ("en", "fr", "de")[k % 3]))
    for k in range(12):
        rows.append(rows[k % 3])
    for k in range(40):
        rows.append(edited(rows[20 + k % 3], 100 + k, k % 9))
    passage, line = prose(999, 70), "All rights reserved, see the imprint."
    for k in range(14):
        rows.append(prose(200 + k, 30) + " " + passage[k:] + "\n" + line + "\n" + prose(300 + k, 15, "fr"))
    rows += ["", None, " ", "\n\n", "a", "A b", "é", "12 34", "!!", "x" * 5000, "ab " * 4000, prose(5, 6000), "<|endoftext|> and <|startoftext|>", "Ünïcode 日本 😀 text"]
    langs = ["en", "fr", "de"]
    out = [(i, t, langs[i % 3] if i % 11 else None, f"src{i % 13}" if i % 17 else None, len(t) if t is not None else None) for i, t in enumerate(rows)]
    return out + [(3, rows[3], "en", "src1", 1), (None, rows[4], "en", "src2", 1), (None, None, None, None, None)]
