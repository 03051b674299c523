"""Token ids of every text of a corpus by a public byte-level BPE vocabulary.

Each partition is encoded by itself, in slices of bounded size:
  1. DuckDB splits the texts into words by the vocabulary's pattern. Its regular expressions know no
     look-ahead, so a run of white space is matched together with the word after it and parted afterwards.
  2. Words that are no token themselves are cut between bytes that stand side by side in no token, which no merge can
     join, and become rows (piece, position, token), one per byte. A recursive query joins neighbours with the merge table
     and contracts each piece's leftmost pair of minimum rank until no pair is left. It keeps the current row of each
     position only, so that memory follows the bytes, not the rounds. Pieces of more than ``LONG`` bytes contract all places
     of their minimum rank in one round, those that overlap from the left on: a merged pair ranks behind its parts, so that
     this is what one contraction after the other comes to. Each distinct word of a slice is merged once.
  3. An ordered aggregation turns the rows back into the ids of each piece, and those into the ids of words and texts.

No shuffle takes place, and a task holds one slice. Defined cases: null and empty texts give an
empty list; a text of blanks is encoded like any other; look-alikes of special tokens are plain text. Words may have any
length; memory grows with the longest. Columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text in a slice, rows of a merge query, bytes above which a piece contracts many places a round.
SLICE, ROWS, LONG = 6_000_000, 400_000, 64
#: Memory of the engine in MB, and bytes for each row beyond ``ROWS`` that a single word brings.
MEMORY, ROW_BYTES = 350, 800
END = 65535

#: The characters with the White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_W = "".join(f"\\x{{{ord(c):x}}}" for c in SPACES)
#: The vocabulary's pattern, with the look-ahead for white space expressed by matching the word after a run, too.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^" + _W + "\\p{L}\\p{N}]+|[" + _W + "]+ (?:\\p{L}+|\\p{N}+|[^" + _W + "\\p{L}\\p{N}]+)|[" + _W + "]+"

#: Rows: piece w, place g, token tok, place nxt and token ntok of the neighbour; a place that was merged away has token -1.
#: One round: ``low`` is each piece's leftmost pair of minimum rank (ranks are ordered as ids), ``pick`` adds
#: what follows its second half.
MERGE = f"""
with recursive bpe(g, w, tok, nxt, ntok) using key (g) as (
  select g, w, tok, nxt, ntok from seeds
  union all
  (with low as materialized (
     select s.w, min(m.id::bigint << 32 | s.g) as k, arg_min(s.nxt, m.id::bigint << 32 | s.g) as second
     from bpe s join merges m on m.pair = s.tok::bigint * 65536 + s.ntok where s.ntok <> {END} group by s.w),
   pick as materialized (
     select l.w, (l.k >> 32)::int as id, (l.k & 4294967295)::int as first, l.second, s.nxt, s.ntok from low l join bpe s on s.g = l.second)
   select s.g, s.w, case when s.g = p.first then p.id when s.g = p.second then -1 else s.tok end, case when s.g = p.first then p.nxt else s.nxt end,
     case when s.g = p.first then p.ntok when s.g = p.second then {END} when s.nxt = p.first then p.id else s.ntok end
   from bpe s join pick p on s.w = p.w where s.tok >= 0)
)
select w, list(tok order by g) as ids from bpe where tok >= 0 group by w order by w
"""

#: The same with all places of the minimum rank in a round. Pairs overlap only where both halves are the same token ('twin'),
#: and of a run of those every other one from its start on is taken.
MERGE_LONG = f"""
with recursive bpe(g, w, tok, nxt, ntok) using key (g) as (
  select g, w, tok, nxt, ntok from seeds
  union all
  (with found as materialized (
     select s.g, s.w, s.nxt, s.tok = s.ntok as twin, m.id from bpe s join merges m on m.pair = s.tok::bigint * 65536 + s.ntok where s.ntok <> {END}),
   least as materialized (select w, min(id) as id from found group by w),
   low as materialized (select f.* from found f join least l on f.w = l.w and f.id = l.id),
   runs as (select g, w, nxt, id, row_number() over o as rn, lag(nxt) over o is distinct from g as opens from low where twin window o as (partition by w order by g)),
   pick as materialized (
     select g, w, nxt, id from low where not twin union all
     select g, w, nxt, id from (select *, max(case when opens then rn end) over (partition by w order by g) as since from runs) where (rn - since) % 2 = 0)
   select s.g, s.w, case when f.g is not null then f.id when d.g is not null then -1 else s.tok end, case when f.g is not null then t.nxt when d.g is not null then -1 else s.nxt end,
     case when d.g is not null then {END} when n.g is not null then n.id when f.g is not null then t.ntok else s.ntok end
   from bpe s semi join least l on s.w = l.w
     left join pick f on s.g = f.g left join pick d on s.g = d.nxt left join bpe t on t.g = f.nxt
     left join pick n on n.g = case when f.g is not null then t.nxt else s.nxt end
   where s.tok >= 0)
)
select w, list(tok order by g) as ids from bpe where tok >= 0 group by w order by w
"""


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    rest = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def _table(x) -> pa.Table:
    return x if isinstance(x, pa.Table) else x.read_all()


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch of n."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _batches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of things that lie between ``offsets``, of ``ROWS`` bytes at most or one thing."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + ROWS, side="right")) - 1)
        yield at, end
        at = end


class Encoder:
    """Encodes lists of texts; one per Python worker and vocabulary file."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for token, i in vocab.items():
            if len(token) == 1 and token in letters:
                self.byte_ids[letters[token]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(ids, ids[1:])) or any(vocab[x] >= i for p, i in zip(pairs, ids) for x in p):
            raise ValueError("ids must be in the order of the merges")
        self.beside = np.zeros((256, 256), dtype=bool)  # bytes that stand side by side in some token
        for a, b in pairs:
            self.beside[letters[a[-1]], letters[b[0]]] = True
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], pa.int64()), "id": pa.array(ids, pa.int32())})
        self.con.register("merge_rows", merges)
        self.con.execute("create table merges as select * from merge_rows")
        self.con.unregister("merge_rows")

    def _contract(self, query: str, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number, of pieces of ``size`` bytes that lie one behind the other in ``codes``."""
        ends = np.cumsum(size)
        g = np.arange(len(codes), dtype=np.int32)
        nxt, ntok = g + 1, np.append(codes[1:], END).astype(np.int32)
        nxt[ends - 1], ntok[ends - 1] = -1, END
        more = max(0, len(codes) - ROWS)
        if more:
            self.con.execute(f"set memory_limit = '{MEMORY + more * ROW_BYTES // 1_000_000}MB'")
        self.con.register("seeds", pa.table({"g": g, "w": np.repeat(np.arange(len(size), dtype=np.int32), size), "tok": codes, "nxt": nxt.astype(np.int32), "ntok": ntok}))
        out = _table(self.con.sql(query).arrow()).column("ids").combine_chunks()
        self.con.unregister("seeds")
        if more:
            self.con.execute(f"set memory_limit = '{MEMORY}MB'")
        out = out.chunk(0) if isinstance(out, pa.ChunkedArray) else out
        return out.values.to_numpy().astype(np.int32), np.diff(out.offsets.to_numpy())

    def _merge(self, joined: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number, of words of ``size`` bytes that lie one behind the other, by the recursive queries."""
        opens = np.ones(len(joined), dtype=bool)
        opens[1:] = ~self.beside[joined[:-1], joined[1:]]
        starts = np.cumsum(size) - size
        opens[starts] = True
        at = np.flatnonzero(opens)
        n = np.diff(np.append(at, len(joined)))
        codes = self.byte_ids[joined]
        counts, parts = np.ones(len(n), dtype=np.int64), []
        for some, query in ((np.flatnonzero((n > 1) & (n <= LONG)), MERGE), (np.flatnonzero(n > max(1, LONG)), MERGE_LONG)):
            for a, b in _batches(np.append(0, np.cumsum(n[some]))):
                chosen = some[a:b]
                flat, counts[chosen] = self._contract(query, codes[_spread(at[chosen], n[chosen])], n[chosen])
                parts.append((chosen, flat))
        begins = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), dtype=np.int32)
        single = n == 1
        out[begins[single]] = codes[at[single]]
        for chosen, flat in parts:
            out[_spread(begins[chosen], counts[chosen])] = flat
        edges = np.append(begins[np.searchsorted(at, starts)], len(out))
        return out, np.diff(edges)

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number, of distinct non-empty words, in batches of about ``ROWS`` bytes."""
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        flats, counts = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        for at, end in _batches(offsets):
            flat, n = self._merge(data[offsets[at] : offsets[end]], np.diff(offsets[at : end + 1]))
            flats.append(flat)
            counts.append(n)
        return np.concatenate(flats), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of non-null texts."""
        self.con.register("slice_rows", pa.table({"i": np.arange(len(texts), dtype=np.int32), "text": texts}))
        lists = _table(self.con.sql("select regexp_extract_all(text, $1) as words from slice_rows order by i", params=[PATTERN]).arrow()).column("words").combine_chunks()
        self.con.unregister("slice_rows")
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        index, found = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        # A run of white space gives up its last character, to the word after it or as a token, unless the text ends with it.
        parted = np.flatnonzero(pc.match_substring_regex(found, f"^[{_W}]{{2}}").to_numpy(zero_copy_only=False))
        pieces: dict[str, int] = {}
        halves, runs = [], []
        for k, w in zip(parted.tolist(), found.take(pa.array(parted)).to_pylist()):
            n = len(w) - len(w.lstrip(SPACES))
            halves += [len(found) + pieces.setdefault(p, len(pieces)) for p in (w[: n - 1], w[n - 1 :])]
            if n == len(w):
                runs.append(k)
        flat, n = self.words(pa.concat_arrays([found, pa.array(pieces, pa.string())]))
        start = np.cumsum(n) - n
        both = np.array(halves, dtype=np.int64)
        start, n = np.append(start, len(flat) + np.cumsum(n[both])[1::2] - n[both].reshape(-1, 2).sum(1)), np.append(n, n[both].reshape(-1, 2).sum(1))
        flat = np.append(flat, flat[_spread(start[both], n[both])])
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        whole = last[np.isin(index[last], np.array(runs, dtype=np.int64))]
        kept = index[whole]
        place = np.arange(len(found), dtype=np.int64)
        place[parted] = len(n) - len(parted) + np.arange(len(parted))
        index = place[index]
        index[whole] = kept
        size = n[index]
        out = flat[_spread(start[index], size)]
        ends = np.append(0, np.cumsum(size))
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(out, pa.int32()))


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    texts = batch.column(column)
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode_corpus(df, doc: str = "doc_id", text: str = "text", directory: str = DEFAULT_DIR, vocabulary: str = VOCABULARY):
    """(doc, ids) for every row of ``df``."""
    from pyspark.sql import functions as F

    path = os.path.join(directory, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "_text", SLICE):
                texts = pc.fill_null(part.column(1), "").cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), Encoder.of(path).encode(texts)], names=["_doc", "ids"])

    rows = df.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    return rows.mapInArrow(encode, f"_doc {kind}, ids array<int>").withColumnRenamed("_doc", doc)


def decode_corpus(df, ids: str = "ids", directory: str = DEFAULT_DIR, vocabulary: str = VOCABULARY):
    """``df`` with ``ids`` replaced by ``text``, the text they stand for; null ids give null. Ids that aren't of one text raise an error."""
    from pyspark.sql import functions as F

    path = os.path.join(directory, vocabulary)
    others = [c for c in df.columns if c != ids]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(raw), dtype=np.uint8)
        for b in batches:
            lists = b.column(ids)
            flat = lists.flatten().to_numpy().astype(np.int64)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(size[flat]))[np.append(0, np.cumsum(n))]
            text = pa.Array.from_buffers(pa.string(), len(b), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[_spread(start[flat], size[flat])])])
            text.validate(full=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))], names=[*others, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*others).schema.fields)
    return df.select(*others, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(decode, f"{schema}, text string")
