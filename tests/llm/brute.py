"""Plain Python counterparts of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(doc_id):
    return (doc_id is not None, doc_id if doc_id is not None else 0)


def fingerprint(text) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def simhash_components(docs, bits=3):
    """doc_id to (fingerprint, component) for distinct ids."""
    fp = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (fp[i], find(i)) for i in ids}


def repeats(docs, depth=100):
    """Rows (doc_id, n_bytes, n_removed, n_spans, sha) of documents with distinct ids."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda r: order(r[0])):
        b = (text or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if b[s : s + depth] in seen:
                hit[s : s + depth] = b"\1" * depth
            seen.add(b[s : s + depth])
        spans = (b"\0" + bytes(hit)).count(b"\0\1")
        out.append((i, len(b), sum(hit), spans, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return out


def line_dedup(docs, min_chars=20, min_docs=3):
    """Rows (doc_id, n_lines, n_dropped, sha)."""
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    key = lambda line: strip.sub("", line).translate(AZ)
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = [
            len(h := holders.get(key(x), ())) >= min_docs and i != max(h, key=order) for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), sha(kept)))
    return out


def leaks(docs, items, k=10):
    """Rows (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if names := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def nearest(vectors, k=20, every=20, scale=64):
    """Rows (query_id, rank, vec_id, score) of usable vectors."""
    import math

    ok = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Source to target from source to size, by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            return full | {s: left * weight[s] / total for s in open_}
        for s in above:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def divergence(docs, min_docs=30, top=50, scale=10**9):
    """Rows (lang, source, part, item, value, rank) from rows (text, lang, source)."""
    from collections import Counter, defaultdict

    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        counts[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        own = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(own.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + scale * (c[t] + 5) // total for t in kept}

        q, p = share(whole), {s: share(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(rows)]
    return out


def passages(docs, n=13):
    """Rows (doc_id, n_words, n_removed, sha)."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, text in docs:
        w = split(text)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, i), i, key=order)
    out = []
    for i, text in docs:
        w = split(text)
        gone = set()
        for s in range(len(w) - n + 1):
            if order(first[tuple(w[s : s + n])]) < order(i):
                gone |= set(range(s, s + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def alignment(docs, a_file, b_file):
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha), by the two public libraries."""
    from collections import Counter

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    letters = sorted(ByteLevel.alphabet())
    byte = {c: ord(c) for c in letters if ord(c) < 256}
    for c, value in zip([c for c in letters if ord(c) >= 256], [v for v in range(256) if v not in byte.values()]):
        byte[c] = value

    def tokens(text):
        if not text:
            return None
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        spell_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in left]
        spell_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()
            for i in right
        ]
        if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
            return None
        return left, right, [len(x) for x in spell_a], [len(x) for x in spell_b]

    def spans(sizes):
        at = 0
        for n in sizes:
            yield at, at + n
            at += n

    found, corpus = [], Counter()
    for i, text in docs:
        if not (t := tokens(text)):
            found.append((i, [], [], []))
            continue
        left, right, size_a, size_b = t
        sa, sb = list(spans(size_a)), list(spans(size_b))
        links, low = [], 0
        for x, (s, e) in enumerate(sa):
            while sb[low][1] <= s:
                low += 1
            y = low
            while y < len(sb) and sb[y][0] < e:
                links.append((left[x], right[y]))
                y += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for cut in cuts:
            groups.append(tuple(
                ",".join(str(k) for k, (s, e) in zip(ids, ranges) if start <= s and e <= cut)
                for ids, ranges in ((left, sa), (right, sb))
            ))
            start = cut
        found.append((i, (left, right), links, groups))
        corpus.update(set(links))
    best = Counter()
    for (x, _), n in corpus.items():
        best[x] = max(best[x], n)
    out = []
    for i, both, links, groups in found:
        if not links:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join("|".join(g) for g in groups)
        out.append((
            i, len(both[0]), len(both[1]), len(groups), len(links), sum(corpus[p] == best[p[0]] for p in links),
            sum(corpus[p] for p in links), sha(text),
        ))
    return out


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def shingles(w, k=5):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def containment(text, template, start, end, widen=True):
    """Share of the template's shingles in the words ``start`` to ``end``, widened by half the template."""
    w, x = word_list(text), word_list(template)
    if len(x) < 5:
        return float(w[start : start + len(x)] == x)
    more = len(x) // 2 if widen else 0
    theirs = shingles(x)
    return len(theirs & shingles(w[max(0, start - more) : end + more])) / len(theirs)


def licenses(docs, templates, share=0.8):
    """(doc, license) that must be found (a window at some start), and that may be (a widened one)."""
    must, may = set(), set()
    wanted = [(name, template, word_list(template)) for name, template in templates]
    for i, text in docs:
        w = word_list(text)
        held = shingles(w)
        for name, template, x in wanted:
            n, theirs = len(x), shingles(x)
            if not n or (n < 5 and len(w) < n) or (n >= 5 and len(held & theirs) < share * len(theirs)):
                continue
            for s in range(max(len(w) - n, 0) + 1):
                if containment(text, template, s, s + n, widen=False) >= share:
                    must.add((i, name))
                if containment(text, template, s, s + n) >= share:
                    may.add((i, name))
    return must, may
