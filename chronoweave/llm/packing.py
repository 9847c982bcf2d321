"""Best-fit packing of token sequences (operator 9).

Documents become token ids, then pieces of at most ``capacity`` tokens. Packing
is bulk-synchronous best fit over rows. A round

1. opens as many empty sequences as the pieces left need at least: their words
   less the gaps that are open, and pieces longer than any gap;
2. sorts pieces and gaps together by size into ranges of about ``range_rows``
   rows (equal sizes are told apart by number, so that one length never makes one
   range) and sweeps each range by itself: from the longest on, a piece takes the
   smallest gap of its range that holds it, and what is left of the gap goes back;
3. settles by rank who gets the gaps that a range has left: ranges below, the
   nearest first, whose pieces found none, are dealt them from the smallest on, as
   many as their pieces can need; each such range is swept once more with its deal;
4. ends with the gaps as they are now, those too small for any piece left out.

A gap that takes a piece in a sweep is afterwards too small for another one of
that range, so that rounds are few (their number follows the logarithm of the
capacity, not the rows). Pieces, gaps and places are tables; the driver holds
six numbers a range and a few sums a round.

Null texts count as empty: a document of the end id only. Repeated rows are
packed as often as they occur. An empty table gives an empty result. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, map_arrow, materialise

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Runs in one generation of a worker's memory.
REMEMBERED = 400_000
#: Latin letters and signs, no controls: on them all versions of Unicode agree what is a letter or a space.
LAST_LATIN = 0x24F
LATIN = regex.compile(f"[\x20-\x7e\xa1-{chr(LAST_LATIN)}]*")
#: White space inside runs, which normalising would turn into a cut or drop.
INNER_SPACE = regex.compile(r"[^\S\x20]")
#: Rows of a range that one task sweeps.
RANGE_ROWS = 1 << 19
#: A round over many ranges takes the pieces longer than this part of the longest.
REACH = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of a text from the ids of its space-separated runs.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    so a text's ids are its runs' ids in order; a run is tokenized once and then
    remembered as little-endian unsigned 32-bit ids. Memories have two
    generations: a full one becomes the older, and runs met again come back.

    Where the vocabulary is a byte-level BPE over the matches of a pattern, runs
    of Latin letters are cut by that pattern here and only unseen matches go to
    the BPE; any other run, or one that holds an added token, is encoded whole.
    Where its tokens are ranked by their ids and words end in a mark, all unseen
    matches of a batch go through the BPE in one call (see ``_ranked``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.matches: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        self.pattern = self._pattern(form)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # every byte of UTF-8 and the sign that stands for it
        text = "".join(map(chr, (*range(0x800), *range(0x800, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)))).encode("utf-8", "ignore").decode()
        self.signs = dict(zip(level.pre_tokenize_str(text)[0][0], text.encode(), strict=True))
        self.as_bytes = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(LAST_LATIN + 1)}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick, self.last = self._ranked(form["model"]) if self.pattern is not None else (None, None)

    @staticmethod
    def _pattern(form: dict) -> regex.Pattern | None:
        """The pattern of matches that the BPE gets one by one, if the vocabulary is of that form."""
        steps = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if form["model"]["type"] != "BPE" or not form.get("normalizer") or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            return None
        cut, level = steps
        if (cut["behavior"], cut["invert"]) != ("Removed", True) or "Regex" not in cut["pattern"] or level["use_regex"] or level["add_prefix_space"]:
            return None
        return regex.compile(cut["pattern"]["Regex"])

    def _ranked(self, model: dict):
        """The BPE as one of bytes, with a space for the mark at a word's end; and which ids end a word.

        A match is followed by one space, which no match holds. A byte and the space
        have lower ranks than all merges, so they become the byte with the mark first.
        """
        import tiktoken

        end, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        merged = [vocabulary["".join(m)] for m in model["merges"]]
        plain = not (model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"))
        if not end or not plain or merged != sorted(set(merged)) or len(vocabulary) - len(merged) != 512 or max(merged) != len(vocabulary) - 1:
            return None, None
        every = {self.as_bytes[i]: i for i in range(0x80)} | self.signs
        lost = [t for t in vocabulary if len(t.removesuffix(end)) == 1 and t.removesuffix(end) not in every]
        spare = iter(sorted(set(range(256)) - set(every.values())))  # bytes that UTF-8 never has
        every |= {t: next(spare) for t in sorted({t.removesuffix(end) for t in lost})}
        last = np.zeros(len(vocabulary), bool)
        ranks = {}
        for token, i in vocabulary.items():
            bare = token.removesuffix(end)
            last[i] = bare != token
            ranks[bytes(every[c] for c in bare) + b" " * int(last[i])] = i
        if len(ranks) != len(vocabulary):
            return None, None
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), last

    def _encode_matches(self, new: list[str]) -> None:
        if self.quick is None:
            for m in new:
                tokens = self.model.tokenize(m.translate(self.as_bytes))
                self.matches[m] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            return
        ids = np.array(self.quick.encode_ordinary(" ".join(new) + " "), "<u4")
        cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        raw = ids.tobytes()
        self.matches.update((m, raw[i:j]) for m, i, j in zip(new, [0, *cuts], cuts, strict=False))

    def _learn(self, new: list[bytes]) -> None:
        if len(self.matches) > REMEMBERED:
            self.matches.clear()
        runs = [r.decode() for r in new]
        joined = " ".join(runs)
        quick = self.pattern is not None and not INNER_SPACE.search(joined)
        normal = self.tokenizer.normalizer.normalize_str(joined) if quick else ""
        plain = normal.split(" ")
        whole: Iterable[int] = range(len(runs))
        if quick and len(plain) == len(runs):
            odd = lambda run, text: not LATIN.fullmatch(text) or any(a in run or a in text for a in self.added)
            whole = [i for i, (run, text) in enumerate(zip(runs, plain, strict=True)) if odd(run, text)] if odd(joined, normal) else []
            find, skip = self.pattern.findall, set(whole)
            found = [() if i in skip else (text,) if text.isalpha() else find(text) for i, text in enumerate(plain)]
            if unseen := {m for ms in found for m in ms if m not in self.matches}:
                self._encode_matches(list(unseen))
            known, matches = self.known, self.matches
            for run, ms, i in zip(new, found, range(len(new)), strict=True):
                if i not in skip:
                    known[run] = matches[ms[0]] if len(ms) == 1 else b"".join([matches[m] for m in ms])
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([runs[i] for i in whole], add_special_tokens=False), strict=True):
                self.known[new[i]] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        runs = text.encode().split()
        known, older = self.known, self.older
        try:
            return b"".join([known[r] for r in runs])
        except KeyError:
            if len(known) > REMEMBERED:
                self.older, self.known = known, {}
                known, older = self.known, self.older
            missed = [r for r in dict.fromkeys(runs) if r not in known]
            known.update((r, older[r]) for r in missed if r in older)
            self._learn([r for r in missed if r not in older])
            return b"".join([known[r] for r in runs])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _forget() -> None:
    """Give back what a worker remembers of texts, before it is used for other things."""
    if _TOKENIZERS:
        _TOKENIZERS.clear()
        lean()


def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces (PIECES), with ``ids array<int>`` if asked for."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokenizer.ids(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    doc.append(key), piece.append(n), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, PIECES + ", ids array<int>" * with_ids)


# --- packing: rows (what, group, nth, id, size, sequence_id, offset) ---------------------

_PLACED, _PIECE, _GAP = 0, 1, 2
_ROWS = "what int, group int, nth long, id long, size long, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, gaps: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces by falling length, each into the smallest open gap that holds it.

    Returns each piece's gap (its place in ``gaps``, or -1), its offset in the
    sequence (a gap stands at its end), and what is left of the gaps.
    """
    open_gaps: dict[int, list[int]] = {}
    sizes = 0  # bit g: a gap of size g is open
    left = gaps.copy()
    for n in range(len(gaps) - 1, -1, -1):  # the first of a size is the first to be taken
        open_gaps.setdefault(int(gaps[n]), []).append(n)
    for g in open_gaps:
        sizes |= 1 << g
    taken, offsets = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        above = sizes >> length
        if not above:
            continue
        gap = length + (above & -above).bit_length() - 1
        same = open_gaps[gap]
        n = same.pop()
        if not same:
            sizes ^= 1 << gap
        taken[i], offsets[i] = n, capacity - gap
        left[n] = rest = gap - length
        if rest:
            open_gaps.setdefault(rest, []).append(n)
            sizes |= 1 << rest
    return taken, offsets, left


def _swept(capacity: int):
    """Rows (group, what, id, size), a group's side by side with gaps first and pieces by falling length, to _ROWS.

    Left gaps no smaller than any row of their group are numbered from the smallest on; the others have the number -1.
    """

    def table(what: int, group: int, nth: np.ndarray, ids: np.ndarray, size: np.ndarray, seq: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), 1 << 16):
            part = slice(i, i + (1 << 16))
            n = len(ids[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, what, np.int32)), pa.array(np.full(n, group, np.int32)), *(pa.array(x[part]) for x in (nth, ids, size, seq, offset))], names=[c.split()[0] for c in _ROWS.split(", ")])

    def sweep(group: int, what: np.ndarray, ids: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        gap = what == _GAP
        gaps, seqs, lengths, uids = size[gap], ids[gap], size[~gap], ids[~gap]
        taken, offsets, left = best_fit(lengths, gaps, capacity)
        hit = taken >= 0
        none = lambda n: np.full(n, -1, np.int64)
        yield from table(_PLACED, group, none(hit.sum()), uids[hit], lengths[hit], seqs[taken[hit]], offsets[hit])
        yield from table(_PIECE, group, none((~hit).sum()), uids[~hit], lengths[~hit], none((~hit).sum()), none((~hit).sum()))
        still = np.lexsort((seqs, left))
        still = still[left[still] > 0]
        nth = none(len(still))
        wide = left[still] >= size.min()
        nth[wide] = np.arange(wide.sum())
        yield from table(_GAP, group, nth, seqs[still], left[still], none(len(still)), none(len(still)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        held: list[list[np.ndarray]] = [[], [], []]
        at = None
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(group)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if i == j:
                    continue
                if at is not None and group[i] != at:
                    yield from sweep(at, *map(np.concatenate, held))
                    held = [[], [], []]
                at = int(group[i])
                for column, values in zip(held, batch.columns[1:], strict=True):
                    column.append(values.to_numpy()[i:j].copy())
        if at is not None:
            yield from sweep(at, *map(np.concatenate, held))

    return run


def deals(summary: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Gaps left, by range and rank, for ranges whose pieces found none: (from range, first rank, last rank + 1, to range).

    ``summary``: (range, pieces left, their greatest length, gaps left, their least size) by falling sizes. As in a
    sweep over all ranges, the smallest gaps above are the last ones seen, hence a stack.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # range, next rank, ranks, least size
    for at, pieces, longest, gaps, least in sorted(summary):
        while pieces > 0 and stack:
            top = stack[-1]
            each = max(1, top[3] // longest)
            n = min(-(-pieces // each), top[2] - top[1])
            out.append((top[0], top[1], top[1] + n, at))
            top[1] += n
            pieces -= n * each
            if top[1] == top[2]:
                stack.pop()
        if gaps:
            stack.append([at, 0, gaps, least])
    return out


def _round(rows: DataFrame, n: int, capacity: int, range_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """One round over ``rows`` (what, id, size), n in number: tables that hold placed rows, and the rows that stay."""
    spark, sweep = rows.sparkSession, _swept(capacity)
    by_size = [F.col("size").desc(), F.col("what").desc(), F.col("id")]
    ranges = rows.repartition(1) if n <= range_rows else rows.repartitionByRange(-(-n // range_rows), *by_size)
    ranges = ranges.withColumn("group", F.spark_partition_id())
    first = materialise(map_arrow(ranges.select("group", "what", "id", "size").sortWithinPartitions("group", *by_size), sweep, _ROWS), "swept")
    left = first.filter((F.col("what") == _PIECE) | (F.col("nth") >= 0)).groupBy("group").agg(
        F.count_if(F.col("what") == _PIECE).alias("pieces"), F.max(F.when(F.col("what") == _PIECE, F.col("size"))).alias("longest"),
        F.count_if(F.col("what") == _GAP).alias("gaps"), F.min(F.when(F.col("what") == _GAP, F.col("size"))).alias("least"),
    )
    dealt = deals([tuple(r) for r in left.collect()])
    stay = first.filter(F.col("what") != _PLACED)
    if not dealt:
        return [first], stay.select("what", "id", "size")
    groups = 1 + max(d[3] for d in dealt)
    # a few rows a range: gaps by the ranks they have, pieces of a range as they are
    given = spark.createDataFrame([(_GAP, *d) for d in dealt] + [(_PIECE, p, -1, 0, p) for p in sorted({d[3] for d in dealt})], "w int, g int, low long, high long, to int")
    fits = (F.col("what") == F.col("w")) & (F.col("group") == F.col("g")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high"))
    routed = stay.join(F.broadcast(given), fits, "left")
    again = routed.filter("to is not null").select(F.col("to").alias("group"), "what", "id", "size").repartitionById(groups, F.col("group"))
    second = materialise(map_arrow(again.sortWithinPartitions("group", *by_size), sweep, _ROWS), "swept")
    return [first, second], routed.filter("to is null").select("what", "id", "size").unionByName(second.filter(F.col("what") != _PLACED).select("what", "id", "size"))


def places(pieces_: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, reach: int = REACH) -> DataFrame:
    """``id, sequence_id, offset`` of pieces ``id`` (distinct longs), ``size`` (1 to ``capacity``)."""
    spark = pieces_.sparkSession
    rows = pieces_.select(F.lit(_PIECE).alias("what"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    done: list[DataFrame] = []
    opened = 0
    while True:
        piece, gap = F.when(F.col("what") == _PIECE, F.col("size")), F.when(F.col("what") == _GAP, F.col("size"))
        now = rows.agg(F.count(piece).alias("pieces"), F.sum(piece).alias("words"), F.min(piece).alias("least"), F.max(piece).alias("longest"), F.count(gap).alias("gaps"), F.sum(gap).alias("room"), F.max(gap).alias("widest")).first()
        if not now["pieces"]:
            break
        widest = now["widest"] or 0
        high = rows.filter((F.col("what") == _PIECE) & (F.col("size") > widest)).agg(F.sum("size")).first()[0] if 0 < widest < now["longest"] else 0
        need = -(-max(now["words"] - (now["room"] or 0), high or 0) // capacity)
        if need > 0:
            rows = rows.unionByName(spark.range(opened, opened + need).select(F.lit(_GAP).alias("what"), "id", F.lit(capacity).cast("long").alias("size")))
            opened += need
        rows = rows.filter((F.col("what") == _PIECE) | (F.col("size") >= now["least"]))
        n = now["pieces"] + now["gaps"] + max(need, 0)
        # one range is swept to its end; of more than one, shorter pieces wait for what this round leaves of its gaps
        low = now["longest"] // reach if n > range_rows else 0
        tables, left = _round(rows.filter(F.col("size") > low), n, capacity, range_rows)
        rows = left.unionByName(rows.filter(F.col("size") <= low)) if low else left
        done += tables
    if not done:
        return spark.createDataFrame([], "id long, sequence_id long, offset long")
    placed = [t.filter(F.col("what") == _PLACED).select("id", "sequence_id", "offset") for t in done]
    return reduce(DataFrame.unionByName, placed)


def pack(parts: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``; ``parts`` is read once.

    Columns of any other name travel as they are; ``parts`` has none of the two names.
    """
    columns = parts.columns
    numbered = materialise(parts.select(F.monotonically_increasing_id().alias("id"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")), "pieces")
    placed = places(numbered.select("id", F.col("row.length").alias("size")), capacity, range_rows)
    return numbered.join(placed, "id").select("row.*", "sequence_id", "offset")


def op9_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of CAPACITY tokens."""
    return pack(pieces(docs, path))
