r"""Best-fit packing with swap-based local search: documents are put best-fit into bins, then documents of underfull bins
are exchanged one-for-one, two-for-one or moved, each time increasing the sum of squared fills, until bins empty.

Only rows of a few numbers for each piece are shuffled, dealt evenly into groups by a running number (so equal rows
spread as well). Each group is packed by itself; what lies in its bins that are not full goes to the next round with
fewer groups, and the last round is one group of at most `group` rows. A bin that is full is final. Once a round fills
hardly any bin (lengths that never add up to the limit), bins more than half full are final too; the search leaves a
group one emptier bin at most, and only these are put together again, so the rounds end.

Defined cases: a null text is empty and is the terminator alone (one piece of length 1); ties of length are packed in the
order of their running number, so which of equal pieces takes which place is open; repeated rows are pieces of
their own; a text over the limit is cut and only its last piece may be shorter; the vocabulary's special tokens are found
inside texts as the library finds them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, record_batch, small_slices

LIMIT, END = 2048, 0
#: Pieces of a group, about.
GROUP = 60_000
#: Pre-tokens of up to 63 bytes that a worker keeps, about 200 bytes each; beyond it starts anew.
KEPT_PARTS = 250_000
#: Signs that may follow a word in a run of their own.
TAIL = ".,;:!?)]}\"|%"

#: The vocabulary's pre-tokens (a fixed value of the public file) and its usual letters for bytes.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _plain)}


class WordTokens:
    """Token numbers of a word (little-endian 16 bits each). Words are what ASCII white space divides; the vocabulary never
    joins over white space, so a text's tokens are those of its words in turn. A word's pre-tokens are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}

    def encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not text.isascii() and (max(text) >= "ɐ" or "İ" in text) or b"<|" in word and any(x in word for x in self.special):
            # special tokens, normal forms and unusual case rules: left to the library
            return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        core = text.rstrip(TAIL)
        if core.isalpha():  # a word, and perhaps one run of signs, which no contraction begins
            return self.part(core) if core == text else self.part(core) + self.part(text[len(core) :])
        return b"".join(map(self.part, PRE_TOKENS.findall(text)))

    def part(self, text: str) -> bytes:
        value = self.parts.get(text)
        if value is None:
            letters = text if text.isprintable() and text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
            value = array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(text) < 64:
                if len(self.parts) >= KEPT_PARTS:
                    self.parts = {}
                self.parts[text] = value
        return value


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The vocabulary of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def token_ids(column: pa.Array, words: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column (little-endian 32 bits), each text's followed by END, and where the texts begin. Each
    distinct word of the column is encoded once; its ids are then copied to all its places."""
    split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    ids = [words.encode(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    size = np.array([len(x) // 2 for x in ids], np.int32)
    flat, first = np.frombuffer(b"".join(ids), "<u2"), np.cumsum(size, dtype=np.int32) - size
    size, first = size[code], first[code]  # of each word in turn
    before = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    begin = before[offsets] + np.arange(len(offsets))  # an END follows each text
    out = np.full(begin[-1], END, "<u4")
    step = np.arange(before[-1], dtype=np.int32)
    out[step + np.repeat(np.arange(len(column), dtype=np.int32), np.diff(before[offsets]))] = flat[np.repeat(first - before[:-1], size) + step]
    return out, begin


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of docs(doc_id, text): their place, the crc32 of their ids, and a running number over all pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64())])
        words = word_tokens(path)
        turn = TaskContext.get().partitionId() << 36
        for batch in small_slices(batches, most=6_000_000):
            ids, begin = token_ids(batch.column(0), words)
            out = []
            for k, doc_id in enumerate(batch.column(1).to_pylist()):
                for piece, start in enumerate(range(begin[k], begin[k + 1], limit)):
                    cut = ids[start : min(start + limit, begin[k + 1])]
                    out.append((doc_id, piece, start - begin[k], len(cut), zlib.crc32(cut), turn))
                    turn += 1
            yield record_batch(schema, *zip(*out))

    return arrow_map(docs.select("text", "doc_id"), run, PIECES)


def best_fit(size: list[int], limit: int) -> list[list[int]]:
    """Items, longest first, each into the fullest bin that takes it. Open bins are found by their room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(size)), key=size.__getitem__, reverse=True):
        n = size[item]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = limit, len(bins)
            bins.append([item])
        left = room - n
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def exchanges(own: list[int]) -> dict[int, tuple[int, ...]]:
    """What a bin with items of these sizes can hand over in one step: one item or two, by their total size."""
    first: dict[int, list[int]] = {}
    for k, n in enumerate(own):
        if len(at := first.setdefault(n, [])) < 2:
            at.append(k)
    out: dict[int, tuple[int, ...]] = {}
    sizes = list(first)
    for k, a in enumerate(sizes):
        for b in sizes[k:]:
            if b != a:
                out[a + b] = (first[a][0], first[b][0])
            elif len(first[a]) > 1:
                out[2 * a] = tuple(first[a])
    return out | {n: (at[0],) for n, at in first.items()}


def local_search(bins: list[list[int]], size: list[int], limit: int) -> list[list[int]]:
    """Moves and swaps between underfull bins, each increasing the sum of squared fills, until none does.

    A taker with `room` that gives up an item of size b (0: none) can take s <= room + b. All (taker, item) are filed
    under the key room + b. A giver with a total s to hand over (one item, or two) looks for the least key from s on:
    it leaves the taker with key - s. The sum of squares grows exactly if the taker ends fuller than the giver was,
    that is if key - s < the giver's room, and if b < s. The sum is a whole number with a bound, so the search ends."""
    fill = [sum(size[i] for i in b) for b in bins]
    filed: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]  # key -> heap of (b, bin, version)
    version, keys = [0] * len(bins), 0

    def file(at: int) -> None:
        nonlocal keys
        version[at] += 1
        room = limit - fill[at]
        if room and bins[at]:
            for b in {0, *(size[i] for i in bins[at])}:
                heapq.heappush(filed[room + b], (b, at, version[at]))
                keys |= 1 << (room + b)

    def find(key: int, total: int, giver: int) -> tuple[int, int] | None:
        """A taker under the key that gives up less than `total`."""
        nonlocal keys
        heap, own = filed[key], None
        while heap and (version[heap[0][1]] != heap[0][2] or heap[0][1] == giver):
            entry = heapq.heappop(heap)
            if version[entry[1]] == entry[2]:
                own = entry  # the giver itself
        got = heap[0][:2] if heap and heap[0][0] < total else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            keys &= ~(1 << key)
        return got

    for at in range(len(bins)):
        file(at)
    waiting, all_wait = set(range(len(bins))), True
    while waiting:
        changed: set[int] = set()
        waiting = {at for at in waiting if 0 < fill[at] < limit}
        for giver in sorted(waiting, key=lambda at: (fill[at], at)):
            while bins[giver] and fill[giver] < limit:
                room, best = limit - fill[giver], None
                for total, items in exchanges([size[i] for i in bins[giver]]).items():
                    upto = total + (room if best is None else best[0])  # what would be left has to be less
                    ahead = keys >> total
                    while ahead:
                        key = total + (ahead & -ahead).bit_length() - 1
                        if key >= upto:
                            break
                        if got := find(key, total, giver):
                            best = (key - total, items, *got)
                            break
                        ahead &= ahead - 1
                    if best and best[0] == 0:
                        break
                if best is None:
                    break
                _, items, b, taker = best
                moved = [bins[giver][k] for k in items]
                back = [next(i for i in bins[taker] if size[i] == b)] if b else []
                for at, out, into in ((giver, moved, back), (taker, back, moved)):
                    bins[at] = [i for i in bins[at] if i not in out] + into
                    fill[at] = sum(size[i] for i in bins[at])
                    file(at)
                    changed.add(at)
        # changed bins give again; once these are done all bins do, as they may have new takers
        waiting, all_wait = (changed, False) if changed or all_wait else (set(range(len(bins))), True)
    return [b for b in bins if b]


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long, sequence_id long, offset long, settled boolean"


def _packer(limit: int, round_: int, final: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("group").sort_by("turn")
        size = rows.column("length").to_pylist()
        bins = local_search(best_fit(size, limit), size, limit)
        n = len(size)
        sequence, offset, settled = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        first = (round_ << 56) | (key[0].as_py() << 20)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + k, at
                at += size[i]
            settled[items] = at >= final
        for name, value in (("sequence_id", sequence), ("offset", offset), ("settled", settled)):
            rows = rows.append_column(name, pa.array(value))
        return rows

    return run


def pack(rows: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Gives each row of `pieces` a sequence and an offset in it."""
    scratch = Scratch(rows.sparkSession, "packing")
    rest, out, round_, before, closing = scratch.save(rows, "pieces"), None, 0, None, False
    while True:
        many = rest.count()
        groups = max(1, -(-many // group))
        last = groups == 1
        closing |= before is not None and 10 * many > 9 * before
        before = many
        final = 0 if last else limit // 2 + 1 if closing else limit
        # a group holds at most a few times `group` rows, as rows are dealt by their running numbers
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("turn", F.lit(round_)), F.lit(groups)))
        packed = scratch.save(dealt.groupBy("group").applyInArrow(_packer(limit, round_, final), PACKED), f"round{round_}")
        if last:
            done = packed
        else:
            done = packed.where("settled")
            rest = packed.where("not settled").drop("sequence_id", "offset", "settled")
        out = done if out is None else out.unionByName(done)
        round_ += 1
        if last:
            scratch.drop("pieces")
            return out.drop("settled")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return pack(pieces(docs, path, limit), limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
