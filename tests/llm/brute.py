"""Plain versions of what the operators must return, and small awkward tables."""

import hashlib
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A passage long enough for every matching rule, and texts with each kind of trouble.
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew potent mixtures of jade and quartz under a pale moon tonight"
TEXTS = [None, "", " ", "\n", "one", "Ünïcode straße ÉCOLE 12 $$ x", PASSAGE, PASSAGE, "Intro words here. " + PASSAGE + " And an end.", "x" * 5000, "word " * 3000, "a b c\td", "<|endoftext|> <s> </s> ▁▁ x", PASSAGE.upper(), "tail\n\n  spaces  \n"]


def docs(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def rows(df, *order):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [str(r[c]) for c in order] if order else str(r))


def crc(text):
    return zlib.crc32((text or "").encode())


def norm_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(texts, items, n=10):
    """(n_words, n_hit, items) for each text."""
    out = []
    for t in texts:
        w, hit, found = norm_words(t), set(), set()
        for item, text in items:
            iw = norm_words(text)
            k = min(n, len(iw))
            for i in range(len(iw) - k + 1 if iw else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == iw[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(item)
        out.append((len(w), len(hit), found))
    return out


def sha(items):
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
