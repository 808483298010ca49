"""Which tokens of two tokenizers stand for the same bytes.

Both encodings of a text spell the same bytes, so their tokens end at byte offsets of one
common axis.  A *link* is a pair of tokens whose byte ranges overlap, a *cut* an offset
where tokens of both sides end; cuts part the tokens into groups.

Merging runs in lockstep: one vector of A pointers and one of B pointers hold the state of
all documents of a batch.  Each step emits every document's current pair as a link, emits a
cut where both tokens end, and moves the pointers whose token ends first; documents that
are through are compacted away.  Long documents take part as several lanes that begin at
cuts, so the number of steps stays bounded.

Pairs are counted over the corpus by documents that hold them linked.  A batch of documents
writes its distinct pairs once, as a dictionary, and its documents refer to that; counts
travel back per batch and pair, not per document and pair.  Every document is a row of its
own and a dictionary is many short rows, so no row grows with a batch; where counts meet
documents, a sort puts those of a batch before its documents and one pass reads both.

Long texts are encoded in parts that begin at a single space between other characters:
both tokenizers always part there.  Whether the tokens spell the text is decided for the
whole document.

Rules for unusual rows: null and empty texts, and texts whose tokens do not spell a space
and the text, have no tokens and zeros everywhere; every row is a document of its own,
repeated ids too; ids are integers and may be null; an empty table gives an empty result;
other columns are ignored.  Needs a byte-level BPE file of the library ``tokenizers`` and a
BPE model with byte fallback of ``sentencepiece``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm.bytesets import chunks
from tidepanel.llm.common import text_of
from tidepanel.sources.sinks import materialize

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Characters of one part of a long text, of the parts merged together, and of the
#: documents that share a dictionary of pairs.
PART, MERGE, BATCH = 1 << 18, 1 << 19, 4 << 20
#: A tokens of one lane, and how far from there a cut is looked for.
LANE, LOOK = 512, 512
#: Pairs of a dictionary in one stored row.
ENTRIES = 1024
# Fixed value: how the byte-level file splits text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANKS = re.compile(r"\s{500}")
BORDER = re.compile(r"[^\s▁] (?=[^\s▁])")


class ByteLevel:
    """Tokenizer A: a byte-level BPE file; its ids double as merge ranks."""

    def __init__(self, source: bytes) -> None:
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        parsed = json.loads(source)
        special = {t["content"] for t in parsed["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in special}
        self.spelling = {i: t for t, i in ranks.items()}
        self._fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self._source, self._slow = source, None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; long runs of blanks overrun the stack of the fast library."""
        if LONG_BLANKS.search(text):
            if self._slow is None:  # few texts need it, and it holds the vocabulary once more
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_str(self._source.decode())
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


class Pieces:
    """Tokenizer B: a BPE model of word pieces; it puts a space before the text itself."""

    def __init__(self, source: bytes) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.spelling = {}
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            whole = bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else None
            self.spelling[i] = whole or piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Spelling:
    """Bytes of token ids as arrays."""

    def __init__(self, spelling: dict[int, bytes]) -> None:
        self.n = max(spelling) + 1
        words = [spelling.get(i, b"") for i in range(self.n)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = self.start[ids] - (np.cumsum(size) - size)
        return self.data[np.arange(size.sum()) + np.repeat(shift, size)]


def parts_of(text: str, size: int = PART) -> list[str]:
    """The text in parts; all but the first begin behind a space that belongs to them."""
    out, low = [], 0
    while len(text) - low > size:
        at = BORDER.search(text, low + size)
        if not at:
            break
        out.append(text[low : at.end() - 1])
        low = at.end()
    return [*out, text[low:]]


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, limit: int = LANE):
    """First A and B token of each lane: every text, and cuts about ``limit`` tokens apart within it."""
    far = []
    for low, high in zip(a_first, np.append(a_first[1:], len(a_end))):
        far.extend(range(low + limit, high - 1, limit))
    more_a, more_b = [], []
    for t in far:
        ends = a_end[t : t + LOOK]
        at = np.searchsorted(b_end, ends)
        hit = np.flatnonzero(b_end[np.minimum(at, len(b_end) - 1)] == ends)
        if len(hit):
            more_a.append(t + hit[0] + 1)
            more_b.append(at[hit[0]] + 1)
    a, keep = np.unique(np.append(a_first, more_a).astype(np.int64), return_index=True)
    b = np.append(b_first, more_b).astype(np.int64)[keep]
    return a[a < len(a_end)], b[a < len(a_end)]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray):
    """Links (A index, B index) and cuts (A index, B index) of all lanes, advanced together."""
    a, b = a_first.copy(), b_first.copy()
    stop = np.append(a_first[1:], len(a_end))
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(a):
        link_a.append(a)
        link_b.append(b)
        x, y = a_end[a], b_end[b]
        cut = x == y
        cut_a.append(a[cut])
        cut_b.append(b[cut])
        a = a + (x <= y)
        b = b + (y <= x)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (link_a, link_b, cut_a, cut_b))


def grouped_text(a_ids, b_ids, cut_a, cut_b, names: np.ndarray) -> list[str]:
    """Tokens of both sides in the order ``a1,a2|b1;a3|b2;``, each with what follows it."""
    ends_a, ends_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    ends_a[cut_a] = ends_b[cut_b] = True
    last_a, last_b = np.flatnonzero(ends_a), np.flatnonzero(ends_b)
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    before = np.concatenate([[0], last_b + 1])  # B tokens before each group
    out[np.arange(len(a_ids)) + before[group_a]] = a_ids * 3 + ends_a
    out[np.arange(len(b_ids)) + last_a[group_b] + 1] = b_ids * 3 + 2 * ends_b
    return names[out].tolist()


class Aligner:
    """Both tokenizers and the merge; one per task."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sa, self.sb = Spelling(self.a.spelling), Spelling(self.b.spelling)
        most = max(self.sa.n, self.sb.n)
        self.names = np.array([f"{i}{sep}" for i in range(most) for sep in ",|;"], object)
        # a piece with a space inside would make parts differ from the whole text
        whole = any(" " in p.lstrip(" ") for p in (t.decode("utf-8", "replace") for t in self.b.spelling.values()))
        self.part = 1 << 62 if whole else PART

    def batch(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Counts of each text, its groups' digest, and its linked pairs."""
        n = len(texts)
        count = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        digests, spelled = [hashlib.sha256() for _ in texts], np.array([bool(t) for t in texts])
        owner, parts = [], []
        for i, t in enumerate(texts):
            if t:
                own = parts_of(t, self.part)
                owner += [i] * len(own)
                parts += own
        owner, keys, times, open_tail = np.array(owner, np.int64), [], [], [""] * n
        for low, high in chunks(parts, MERGE):
            self._merge(parts[low:high], owner[low:high], count, digests, open_tail, spelled, keys, times)
        width = self.sa.n * self.sb.n
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        time = np.concatenate([np.zeros(0, np.int64), *times])
        key, time = key[spelled[key // width]], time[spelled[key // width]]
        key, at = np.unique(key, return_inverse=True)  # parts of one text can share pairs
        time = np.bincount(at, time, len(key)).astype(np.int64) if len(key) else time
        for c in count.values():
            c[~spelled] = 0
        for i, tail in enumerate(open_tail):
            digests[i].update(tail[:-1].encode())
        return count | {
            "groups": [d.hexdigest() if ok else "" for d, ok in zip(digests, spelled)],
            "owner": key // width, "pair": key % width, "times": time,
        }

    def _merge(self, parts, owner, count, digests, open_tail, spelled, keys, times) -> None:
        a = [self.a.encode(" " + p) for p in parts]
        b = self.b.encode(parts)
        a_n, b_n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a_ids, b_ids = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        bodies = [p.encode() for p in parts]
        size = np.array([len(x) + 1 for x in bodies])
        data = np.frombuffer(b" " + b" ".join(bodies), np.uint8)
        a_part, b_part = (np.repeat(np.arange(len(parts)), n) for n in (a_n, b_n))
        good = np.ones(len(parts), bool)
        for ids, part, spelling in ((a_ids, a_part, self.sa), (b_ids, b_part, self.sb)):
            good &= np.bincount(part, spelling.size[ids], len(parts)) == size
        for ids, part, spelling in ((a_ids, a_part, self.sa), (b_ids, b_part, self.sb)):
            own, fits = np.repeat(good, size), good[part]
            wrong = np.flatnonzero(spelling.spell(ids[fits]) != data[own])
            at = np.repeat(np.flatnonzero(good), size[good])[wrong]
            good[at] = False
        spelled[owner[~good]] = False
        good &= spelled[owner]
        a_ids, b_ids, a_part, b_part = a_ids[good[a_part]], b_ids[good[b_part]], a_part[good[a_part]], b_part[good[b_part]]
        if not len(a_ids):
            return
        kept = np.flatnonzero(good)
        a_end, b_end = np.cumsum(self.sa.size[a_ids]), np.cumsum(self.sb.size[b_ids])
        a_first, b_first = np.searchsorted(a_part, kept), np.searchsorted(b_part, kept)
        la, lb, ca, cb = lockstep(a_end, b_end, *lanes(a_end, b_end, a_first, b_first))
        doc_a, doc_b = owner[a_part], owner[b_part]
        n = len(spelled)
        for name, docs in (("n_a", doc_a), ("n_b", doc_b), ("n_groups", doc_a[ca]), ("n_links", doc_a[la])):
            count[name] += np.bincount(docs, minlength=n)
        key, time = np.unique(
            (doc_a[la] * self.sa.n + a_ids[la]) * self.sb.n + b_ids[lb], return_counts=True
        )
        keys.append(key)
        times.append(time)
        shown = grouped_text(a_ids, b_ids, ca, cb, self.names)
        docs, first = np.unique(doc_a, return_index=True)
        cuts = [*(first + np.searchsorted(doc_b, docs)), len(shown)]
        for i, low, high in zip(docs, cuts, cuts[1:]):
            digests[i].update(open_tail[i].encode())  # its last separator stays unless this was the end
            open_tail[i] = "".join(shown[low:high])


#: A row is a document, or, where ``at`` is null, pairs of its batch's dictionary from ``first`` on.
STORED = (
    "batch long, doc long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "at array<int>, times array<int>, first int, pair array<long>, docs array<int>"
)
SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("batch", "doc", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("first", pa.int32()), ("pair", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
)


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows as stored; a column is an array, or flat values and where each row's begin, or null."""
    out = []
    for field in SCHEMA:
        value = columns.get(field.name)
        if isinstance(value, tuple):
            flat, first = value
            flat = pa.array(flat, field.type.value_type)
            value = pa.ListArray.from_arrays(pa.array(first, pa.int32()), flat)
        elif not isinstance(value, pa.Array):
            value = pa.nulls(n, field.type) if value is None else pa.array(value, field.type)
        out.append(value)
    return pa.record_batch(out, schema=SCHEMA)


def aligned(docs: DataFrame, a_file: str, b_file: str, key: str, text: str) -> DataFrame:
    """Documents with their figures and the dictionary entries they link; the dictionary of each batch."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:  # a few MB: the size of the vocabularies
        sources = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def scan(batches):
        aligner, number = Aligner(*sources.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.columns
            sizes = [range(x) for x in pc.utf8_length(texts).to_pylist()]
            for low, high in chunks(sizes, BATCH):
                found = aligner.batch(texts[low:high].to_pylist())
                pair, at = np.unique(found["pair"], return_inverse=True)
                first = np.searchsorted(found["owner"], np.arange(high - low + 1))
                yield _rows(
                    high - low, batch=np.full(high - low, number), doc=ids[low:high],
                    **{c: found[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups")},
                    at=(at, first), times=(found["times"], first),
                )
                starts = np.arange(0, len(pair), ENTRIES)
                ends = np.append(starts, len(pair))
                yield _rows(
                    len(starts), batch=np.full(len(starts), number), first=starts,
                    pair=(pair, ends), docs=(np.bincount(at, minlength=len(pair)), ends),
                )
                number += 1

    picked = docs.select(F.col(key).cast("long").alias("doc"), text_of(text).alias("text"))
    return picked.mapInArrow(scan, STORED)


def pair_counts(batches: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: documents that hold the pair, and the highest such number of its A id."""
    each = batches.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.pair", "p.docs")
    total = each.groupBy("pair").agg(F.sum("docs").alias("n"))
    # an A id has at most as many pairs as there are B ids
    of_a = Window.partitionBy(F.expr(f"pair div {width}"))
    return total.withColumn("best", F.max("n").over(of_a) == F.col("n"))


RESULT = "doc long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(
    docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Per document its tokens, groups, links and how common they are; and the table of pairs.

    Documents: ``doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, where
    ``groups`` is the SHA-256 of its groups as text.  Pairs: ``a, b, n, best``.
    """
    with open(b_file, "rb") as file:
        width = Spelling(Pieces(file.read()).spelling).n
    stored = materialize(aligned(docs, a_file, b_file, key, text), "aligned")
    counts = materialize(pair_counts(stored, width), "pair-counts")
    asked = stored.select("batch", "first", F.posexplode("pair").alias("nth", "pair"))
    told = asked.join(counts, "pair").select("batch", (F.col("first") + F.col("nth")).alias("pos"), "n", "best")
    own = F.struct("doc", "n_a", "n_b", "n_groups", "n_links", "groups")
    owned = stored.where("at is not null").select("batch", own.alias("own"), "at", "times")
    # lists are empty, not null, beside counts: Arrow's size check passes over all nulls since the last list, at each row
    none = F.array().cast("array<int>")
    # the counts of a batch come at its even turn, its documents at the odd one
    turns = told.withColumns({"turn": F.expr("2 * batch"), "at": none, "times": none}).unionByName(
        owned.withColumn("turn", F.expr("2 * batch + 1")), allowMissingColumns=True
    )
    whole = turns.repartition("batch").drop("batch").sortWithinPartitions("turn")

    def finish(batches):
        names = ["doc", "n_a", "n_b", "n_groups", "n_links"]
        turn, heard, n, best = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(turns)) + 1), len(turns)]
            for low, high in zip(edges, edges[1:]):
                part = batch.slice(low, high - low)
                if not len(part):
                    continue
                if turns[low] % 2 == 0:
                    heard = heard if turn == turns[low] else []
                    turn = turns[low]
                    heard.append([np.asarray(part.column(c)) for c in ("pos", "n", "best")])
                    continue
                if turn != turns[low]:
                    known = heard if turn == turns[low] - 1 else []  # no pairs: no links
                    turn, heard = turns[low], []
                    pos = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in known)])
                    n, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                    for at, many, top in known:
                        n[at], best[at] = many, top
                row = dict(zip([*names, "groups"], part.column("own").flatten()))
                at, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "times"))
                first = np.concatenate([[0], np.cumsum(part.column("at").value_lengths().to_numpy())])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                columns = [row[c] for c in names]
                columns += [pa.array(total(best[at] * times)), pa.array(total(n[at] * times)), row["groups"]]
                yield pa.record_batch(columns, names=[*names, "n_best", "count_sum", "groups"])

    pairs = counts.select(
        F.expr(f"pair div {width}").cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "n", "best"
    )
    return whole.mapInArrow(finish, RESULT), pairs
