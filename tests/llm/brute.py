"""Plain Python versions of the text operators, for comparison on small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

BLANK = " \t\n\x0b\x0c\r"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text: str | None) -> list[str]:
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def lines(docs):
    first = {}
    key = lambda line: line.strip(BLANK).translate(FOLD)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), doc), doc)
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if doc is None or len(key(x)) < 10 or first[key(x)] >= doc]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def contamination(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(FOLD))
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i : i + k])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(FOLD))
        hit, of = set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if found := windows.get(tuple(words[i : i + k])):
                    hit.update(range(i, i + k))
                    of |= found
        out.append((doc, len(words), len(hit), len(of), sha(",".join(sorted(map(str, of)))), bool(hit)))
    return out


def substrings(docs, n=13):
    first = {}
    for doc, text in docs:
        words = plain_words(text)
        for i in range(len(words) - n + 1) if doc is not None else ():
            w = tuple(words[i : i + n])
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in docs:
        words, gone = plain_words(text), set()
        for i in range(len(words) - n + 1) if doc is not None else ():
            if first[tuple(words[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(words), len(gone), sha(" ".join(x for i, x in enumerate(words) if i not in gone))))
    return out


def shingles(text, k):
    words = plain_words((text or "").translate(FOLD))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near(docs, k=2, percent=80):
    """Components by comparing every pair that shares a shingle."""
    sets = {doc: shingles(text, k) for doc, text in docs}
    holders, parent = defaultdict(list), {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for doc, own in sets.items():
        for s in own:
            holders[s].append(doc)
    for doc, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for other in holders[s]:
                if other < doc:
                    shared[other] += 1
        for other, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return [(doc, len(sets[doc]), root(doc), root(doc) == doc) for doc in sets]


def quality_base(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = plain_words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if plain_words(line):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        rep = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
        n = len(words)
        out.append((doc, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n))
    return out


@lru_cache
def encodings():
    """The two public vocabularies by their own libraries."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return library, tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def quality_kept(docs, bands, script_bands, default):
    """doc_ids of (doc, text, lang) that the base rules and the bands keep."""
    library, multi = encodings()
    failed = {doc for doc, *_, bad in quality_base([(d, t) for d, t, _ in docs]) if bad}
    out = []
    for doc, text, lang in docs:
        if doc in failed:
            continue
        ids = library.encode(text, add_special_tokens=False).ids
        tokens, n = [library.decode([i]) for i in ids], len(ids)
        letters = Counter(unicodedata.name(c, "?").split()[0].lower() for c in text if unicodedata.category(c)[0] == "L")
        script = letters.most_common(1)[0][0] if letters else None
        b = bands.get(lang) if script == "latin" else None
        b = b or script_bands.get(script, default)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) / math.log2(n)
        signs = sum(t.isascii() and bool(t.strip()) and not any(c.isalnum() for c in t) for t in tokens)
        inside = b.least <= len(text) / n <= b.most and b.multi_least <= len(text) / len(multi.encode_ordinary(text)) <= b.multi_most
        if inside and sum("\ufffd" in t for t in tokens) / n <= b.fragments and entropy >= b.entropy and signs / n <= b.signs:
            out.append(doc)
    return out


def deduped_lines(docs):
    """(doc, text) without the lines that lines() counts as dropped."""
    first, key = {}, lambda line: line.strip(BLANK).translate(FOLD)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), doc), doc)
    return [(doc, "\n".join(x for x in (text or "").split("\n") if len(key(x)) < 10 or first[key(x)] >= doc)) for doc, text in docs]


def with_periods(doc, text):
    h = None if doc is None else zlib.crc32(str(doc).encode())
    words = plain_words(text)
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def all_runs(words):
    """Every (start, length, period) by trying each period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_runs(docs):
    out = []
    for doc, text in docs:
        words = with_periods(doc, text)
        runs = all_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        share = 1000 * top[1] // top[2] if runs else None
        out.append((doc, len(runs), *top, share, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs))))
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def noisy_words(docs):
    """Words of at least 7 letters found twice or more, with their counts."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            at = h % len(run)
            n[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def variants(words, factor=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out
