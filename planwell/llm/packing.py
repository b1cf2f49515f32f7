"""Best-fit packing of token sequences by hierarchical residual packing.

Every task packs its own documents best-fit (longest first) into bins of ``capacity`` tokens.  A bin
can still gain only from bins that are at most half full, and a packing by best fit leaves at most one
of those, so a node of the merge tree passes on that bin and, of the fuller ones, the emptiest: as many
as the tree has nodes, which is as many as could ever receive something.  All other bins are emitted.
Nodes are merged ``fan_in`` at a time, the passed-on bins being items of the next best-fit round, until
one node is left.  What a node reads is bounded by the number of nodes, not by the data.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.llm.common import arrow_rows, columns, release, utf8
from planwell.session import checkpoint, discard

CAPACITY = 4096
TEXT_BYTES = 4 << 20
END_ID = 1


def best_fit(sizes, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit packing of ``sizes`` in the given order: (bin of each, offset of each, fill of each bin).

    Bins are kept by their free space; a bit set of the spaces in use finds the tightest fit.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        fit = used >> size
        if size <= capacity and fit:
            space = size + ((fit & -fit).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        if rest := space - size:
            free[rest].append(b)
            used |= 1 << rest
    return bins, offsets, fills


class WordIds:
    """Token ids of whole texts, put together from remembered ids of words.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
    of its words; of a word that is letters and then ``marks``, they are those of the two parts, which are
    words themselves.  The memory has two generations: at ``limit`` words the younger becomes the older one,
    and words met again move to the younger, so frequent words stay known and rare ones go.
    """

    limit = 60_000
    marks = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def one(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def known(self, word: bytes) -> bool:
        if word not in self.words:
            ids = self.older.get(word)
            if ids is None:
                return False
            self.words[word] = ids
        return True

    def forget(self) -> None:
        self.words, self.older = {}, {}

    def learn(self, missing: set[bytes]) -> None:
        met = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in met)
        marked, new = [], set()
        for raw in missing - met:
            letters = raw.rstrip(self.marks)  # a mark is one byte
            if letters.isalpha() and len(letters) < 100 or (core := letters.decode()).isalpha() and len(core) < 100:
                if len(letters) == len(raw):
                    new.add(raw)
                else:
                    marked.append((raw, letters))
                    if letters not in missing and not self.known(letters):
                        new.add(letters)
            else:
                self.words[raw] = self.one(raw.decode())
        new = sorted(new)
        for i in range(0, len(new), 2000):  # one call for many words: each ends in exactly one end-of-word token
            part = new[i : i + 2000]
            # the fast form leaves out the places in the text; the ids are the same
            text = self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(text.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1:] == [len(ids)]:
                data, ends = ids.tobytes(), (cuts * 4).tolist()
                self.words.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self.words.update((w, self.one(w.decode())) for w in part)
        for raw, letters in marked:
            tail = raw[len(letters):]
            if not self.known(tail):
                self.words[tail] = self.one(tail.decode())
            self.words[raw] = self.words[letters] + self.words[tail]

    def encode(self, texts, text_bytes: int = TEXT_BYTES):
        """Little-endian unsigned 32-bit ids of each text (bytes).  Works through ``text_bytes`` of texts at a time, and for
        fewer bytes it also remembers fewer words.

        Words are split and numbered by Arrow, so a word is looked up once in so many texts; the ids of a text are then
        gathered from those of its words.
        """
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        for rows in arrow_rows([pa.record_batch([texts], names=["text"])], text_bytes):
            yield from self._encode(rows.column(0), min(self.limit, text_bytes // 50))

    def _encode(self, texts: pa.Array, limit: int):
        if len(self.words) > limit:
            self.older, self.words = self.words, {}
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))  # white space and letters of ASCII, as in bytes
        numbered = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy()).tolist()
        words = numbered.dictionary.view(pa.binary()).to_pylist()
        word = numbered.indices.to_numpy()
        if missing := set(words) - self.words.keys():
            self.learn(missing)
        ids = list(map(self.words.__getitem__, words))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(ids), "<u4")
        begin, i = 0, 0
        while i < len(ends):
            k, stop = i, ends[i]
            while i < len(ends) and ends[i] - begin <= 1 << 18 or i == k:  # words gathered at once, or one text
                stop, i = ends[i], i + 1
            some = word[begin:stop]
            n = size[some]
            upto = np.cumsum(n)
            found = ids[np.repeat(start[some] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
            upto, at = np.concatenate([[0], upto]), 0
            for e in ends[k:i]:
                to = upto[e - begin]
                yield found[at:to].tobytes()
                at = to
            begin = stop


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer of a file, kept from task to task."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def _tokenise_and_pack(path: str, capacity: int, end_id: int, with_ids: bool, schema: pa.Schema, node_pieces: int,
                       node_tokens: int, text_bytes: int):
    """One task's documents, tokenised, cut and packed node by node."""
    end = np.array([end_id], "<u4").tobytes()

    def node(part: int, chunk: int, pieces: list) -> pa.RecordBatch:
        # longest first; ties by document, piece and content, so that a rerun packs alike
        pieces.sort(key=lambda p: (-p[3], p[0] is None, p[0] or 0, p[1], p[4]))
        bins, offsets, fills = best_fit([p[3] for p in pieces], capacity)
        base = (part << 40) | (chunk << 24)
        half = capacity // 2
        emptiest = {b: i for i, b in enumerate(sorted((b for b, f in enumerate(fills) if f > half),
                                                       key=lambda b: (fills[b], b)))}
        data = {
            "doc_id": [p[0] for p in pieces], "piece": [p[1] for p in pieces], "start": [p[2] for p in pieces],
            "length": [p[3] for p in pieces], "ids_crc32": [p[4] for p in pieces], "bin": [base + b for b in bins],
            "offset": offsets, "part": [part] * len(pieces), "fill": [fills[b] if o == 0 else None for b, o in zip(bins, offsets)],
            "rank": [emptiest.get(b, -1) if o == 0 else None for b, o in zip(bins, offsets)],
        }
        if with_ids:
            data["ids"] = [np.frombuffer(p[5], "<u4").astype(np.int32) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array(v, type=schema.field(k).type) for k, v in data.items()], schema=schema)

    def run(it):
        from pyspark import TaskContext

        ids = word_ids(path)
        part, chunk, pieces, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in arrow_rows(it):
            for doc_id, data in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1), text_bytes)):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    pieces.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                    tokens += len(cut) // 4
                if len(pieces) >= node_pieces or with_ids and tokens >= node_tokens:
                    yield node(part, chunk, pieces)
                    chunk, pieces, tokens = chunk + 1, [], 0
        if pieces:
            yield node(part, chunk, pieces)
        # the worker may serve other operators next: the words and what the allocators hold beyond them go back
        ids.forget()
        release()

    return run


def _merge(capacity: int):
    """One node of the tree: its bins are the items of another best-fit round."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True])
        ids = pdf["bin"].to_numpy()
        bins, shifts, fills = best_fit(pdf["fill"].tolist(), capacity)
        first = np.full(len(fills), -1, np.int64)
        for i, b in enumerate(bins):
            if first[b] < 0:
                first[b] = ids[i]
        order = sorted((b for b, f in enumerate(fills) if f > capacity // 2), key=lambda b: (fills[b], first[b]))
        rank = {b: i for i, b in enumerate(order)}
        out = pd.DataFrame({"node": pdf["node"].iloc[0], "bin": ids, "into": first[bins], "shift": shifts})
        out["fill"] = [fills[b] if s == 0 else None for b, s in zip(bins, shifts)]
        out["rank"] = [rank.get(b, -1) if s == 0 else None for b, s in zip(bins, shifts)]
        return out.astype({"fill": "Int64", "rank": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = 8,
         with_ids: bool = False, node_pieces: int = 200_000, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Pack every row of ``docs`` (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``with_ids``, the ids themselves.  Null and empty texts are the end id alone; a text longer than a
    sequence is cut into full pieces and a rest; repeated rows are packed once each; a null doc_id stays
    null; an empty table gives none.  Columns besides the two are ignored.  ``tokenizer`` is the path of
    a ``tokenizers`` file that every executor can read.  ``node_pieces`` bounds a task's memory,
    and so does ``text_bytes``, the text that is numbered at once: less of it takes longer and gives the same ids.
    """
    id_type = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
              *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "bin", "offset", "part", "fill", "rank")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _tokenise_and_pack(tokenizer, capacity, end_id, with_ids, to_arrow_schema(schema), node_pieces, 16 << 20,
                             text_bytes)
    placed = checkpoint(columns(docs, "doc_id", "text").select("doc_id", utf8("text").alias("text")).mapInArrow(run, schema))
    bins = placed.filter("offset = 0").select("bin", "part", "fill", "rank")
    # leaves are numbered by task and chunk; the first level joins a task's chunks, the next ones fan_in nodes each
    parts, leaves = bins.agg(F.max("part"), F.countDistinct(F.shiftright("bin", 24))).first()
    nodes, width, node = leaves, (parts or 0) + 1, F.col("part")
    moves, made, merge = None, [], _merge(capacity)
    while nodes > 1:
        # what can matter: a bin at most half full, and of the emptiest others as many as there are nodes
        items = bins.filter((F.col("rank") >= 0) & (F.col("rank") < nodes) | (F.col("rank") < 0) & (F.col("fill") <= capacity // 2))
        level = checkpoint(items.withColumn("node", node.cast("long")).groupBy("node").applyInPandas(
            merge, "node long, bin long, into long, shift long, fill long, rank long"))
        made.append(level)
        moved = level.filter("shift > 0").select("bin", "into", "shift")
        if moves is None:
            moves = moved
        else:  # what has been moved moves on with the bin that holds it
            on = moved.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("shift").alias("more"))
            moves = moves.join(on, "into", "left").select(
                "bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            ).unionByName(moved)
        if width == 1:
            break
        bins = level.filter("shift = 0").select("bin", F.col("node").alias("part"), "fill", "rank")
        nodes, width, node = width, -(-width // fan_in), F.floor(F.col("part") / fan_in)
    if moves is not None:
        placed = placed.join(checkpoint(moves), "bin", "left").withColumn("bin", F.coalesce("into", "bin")).withColumn(
            "offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
        discard(*made)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return placed.select(*out, *(["ids"] if with_ids else []))
