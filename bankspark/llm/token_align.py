"""Alignment of two tokenizers' tokens of the same text.

Tokens of both sides are cut at the byte offsets where a token of either side ends. The shorter list
of ends drives a galloping search (doubling steps, then binary search) into the longer one; the common
ends slice both sides into groups, and the ranks between two common ends are the tokens that overlap.

Both tokenizers work on a text's words alone: a word with the blanks before it is encoded once per
worker and remembered, since no token goes on over a blank that follows a word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankspark.llm.byte_bpe import text_slices

CACHE_WORDS = 300_000  # distinct words that a Python worker remembers
PART_LINKS = 400_000  # links that share a list of pairs; a text with more is a part of its own
SLICE_CHARS = 1 << 19

LEARN = 4096  # new words encoded at once

#: How the byte-level tokenizer splits ASCII text before its merges.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_LATE_BLANK = re.compile(r"\s ")


class TokenPairs:
    """The ids that a byte-level and a piece tokenizer give to words with the blanks before them."""

    def __init__(self, byte_level_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.bytes_side = Tokenizer.from_file(byte_level_path)
        self.bytes_side.encode_special_tokens = True
        self.piece_side = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in own]
        value = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.letters = {b: c for c, b in value.items()}
        size = self.bytes_side.get_vocab_size(with_added_tokens=False)
        entries = [self.bytes_side.id_to_token(k) for k in range(size)]
        self.bytes_of = (
            [bytes(value[c] for c in e) if e is not None and all(c in value for c in e) else b"" for e in entries],
            [
                bytes([int(p[3:5], 16)]) if self.piece_side.is_byte(k) else p.replace("▁", " ").encode()
                for k, p in enumerate(self.piece_side.id_to_piece(k) for k in range(self.piece_side.get_piece_size()))
            ],
        )
        self.length_of = tuple(np.array([len(b) for b in side], np.int64) for side in self.bytes_of)
        if any("▁" in p.lstrip("▁") for p in (self.piece_side.id_to_piece(k) for k in range(self.piece_side.get_piece_size()))):
            raise ValueError("a piece goes on over a blank: words cannot be encoded one by one")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = array("i"), array("i")
        self.start = array("q", [0]), array("q", [0])
        self.whole = array("b")  # whether both sides give back the word's bytes
        self.arrays = None

    @staticmethod
    def words(text: str) -> list[str]:
        """A text that begins with a blank, cut before blanks that follow a word; the first blank is left out."""
        if _LATE_BLANK.search(text) is None:
            return text.split(" ")[1:]
        return [word[1:] for word in _SAFE_CUT.split(text)]

    def _byte_level_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of the words with a blank before them; the merges alone are asked where the split is known."""
        found: list[list[int]] = []
        others = []
        merge = self.bytes_side.model.tokenize
        for word in words:
            ids: list[int] = []
            if word.isascii():
                for piece in _ASCII_PIECES.findall(" " + word):
                    letters = piece.replace(" ", self.letters[32]) if piece.isprintable() else piece.translate(self.letters)
                    ids += [t.id for t in merge(letters)]
            else:
                others.append(len(found))
            found.append(ids)
        encoded = self.bytes_side.encode_batch_fast([" " + words[k] for k in others], add_special_tokens=False)
        for k, e in zip(others, encoded, strict=True):
            found[k] = e.ids
        return found

    def _learn(self, words: list[str]) -> None:
        left, right = self._byte_level_ids(words), self.piece_side.encode(words, num_threads=1)
        if "" in words:  # a blank at the end of a text: alone it would count as no text
            right[words.index("")] = self.piece_side.encode("a ")[len(self.piece_side.encode("a")) :]
        texts = [b" " + word.encode() for word in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        same = np.ones(len(words), bool)
        all_bytes = b"".join(texts)
        exact = True
        for ids, flat, start, token, length_of in zip((left, right), self.flat, self.start, self.bytes_of, self.length_of, strict=True):
            stops = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            own = np.fromiter(chain.from_iterable(ids), np.int32, int(stops[-1]))
            start.frombytes((stops + len(flat)).tobytes())
            flat.frombytes(own.tobytes())
            same &= np.diff(np.concatenate([[0], np.cumsum(length_of[own])])[np.concatenate([[0], stops])]) == lengths
            exact = exact and b"".join(map(token.__getitem__, own.tolist())) == all_bytes
        if not exact:  # some word is not given back: compare one by one
            for k in np.flatnonzero(same):
                same[k] = all(b"".join([token[i] for i in side[k]]) == texts[k] for side, token in zip((left, right), self.bytes_of, strict=True))
        self.whole.frombytes(same.astype(np.int8).tobytes())
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.arrays = None

    def look_up(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per side the ids of all words and the number of ids per word; whether each word is given back."""
        new = list(set(words).difference(self.place))
        if len(self.place) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(set(words))
        for k in range(0, len(new), LEARN):
            self._learn(new[k : k + LEARN])
        if self.arrays is None:
            self.arrays = [(np.array(f, np.int32), np.array(s, np.int64)) for f, s in zip(self.flat, self.start, strict=True)], np.array(self.whole, bool)
        sides, whole = self.arrays
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        found = []
        for flat, start in sides:
            size = start[at + 1] - start[at]
            after = np.cumsum(size)
            total = int(after[-1]) if len(after) else 0
            found.append((flat[np.repeat(start[at] - (after - size), size) + np.arange(total)], size))
        return found, whole[at]


def gallop(needles: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank in ``longer`` (rising) of its first entry that is not less than each needle.

    Every needle begins at its own ``start`` (no later than its place) and doubles its step until it
    is passed, then halves the range. The last entry must not be less than any needle.
    """
    low, high = start.copy(), start.copy()
    behind = np.flatnonzero(longer[high] < needles)
    step = 1
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, len(longer) - 1)
        behind = behind[longer[high[behind]] < needles[behind]]
        step *= 2
    wide = np.flatnonzero(low < high)
    while len(wide):
        middle = (low[wide] + high[wide]) // 2
        less = longer[middle] < needles[wide]
        low[wide[less]] = middle[less] + 1
        high[wide[~less]] = middle[~less]
        wide = wide[low[wide] < high[wide]]
    return low


def common_ends(left: np.ndarray, right: np.ndarray, words: tuple[np.ndarray, np.ndarray], document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of rising ends where a token of either side ends.

    ``words`` gives the number of tokens per word on each side, ``document`` the document of each word:
    in each document the side with fewer ends drives the search; a needle starts where its word does.
    """
    per_document = [np.bincount(document, n) for n in words]
    left_drives = (per_document[0] <= per_document[1])[document]
    ranks = []
    for mine, other, (n, m), drives in ((left, right, words, left_drives), (right, left, words[::-1], ~left_drives)):
        needle = np.flatnonzero(np.repeat(drives, n))
        start = np.repeat(np.cumsum(m) - m, n)[needle]
        place = gallop(mine[needle], other, start)
        same = other[place] == mine[needle]
        ranks.append((needle[same], place[same]))
    return np.sort(np.concatenate([ranks[0][0], ranks[1][1]])), np.sort(np.concatenate([ranks[0][1], ranks[1][0]]))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


_written: list[bytes] = []


def _group_text(ids: tuple[np.ndarray, np.ndarray], stops: tuple[np.ndarray, np.ndarray], groups: np.ndarray) -> list[bytes]:
    """Per document ``a1,a2|b1;a3|b2``: ids of either side by group. ``groups`` counts them per document."""
    number, after = [], []
    last_of_text = np.zeros(len(stops[0]), bool)
    last_of_text[np.cumsum(groups)[groups > 0] - 1] = True
    for side in (0, 1):
        sign = np.zeros(len(ids[side]), np.int64)  # 0: comma
        sign[stops[side] - 1] = 1 if side == 0 else np.where(last_of_text, 3, 2)
        number.append(ids[side])
        after.append(sign)
    in_group = [np.diff(np.concatenate([[0], s])) for s in stops]
    before = [np.cumsum(in_group[1]) - in_group[1], np.cumsum(in_group[0])]  # tokens of the other side written earlier
    code = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for side in (0, 1):
        code[np.arange(len(ids[side])) + np.repeat(before[side], in_group[side])] = number[side].astype(np.int64) * 4 + after[side]
    for c in range(len(_written), int(code.max(initial=-1)) + 1):  # at most four per id of the vocabularies
        _written.append(b"%d%s" % (c // 4, (b",", b"|", b";", b"")[c % 4]))
    parts = list(map(_written.__getitem__, code.tolist()))
    at = _starts(groups)
    stop = np.concatenate([[0], stops[0]])[at] + np.concatenate([[0], stops[1]])[at]
    return [b"".join(parts[lo:hi]) for lo, hi in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]


LISTS = ("a_ids", "b_ids", "a_stops", "b_stops", "a_links", "b_links")
OUTPUTS = (*LISTS, "groups")


def align_part(pairs: TokenPairs, texts: list[str | None], outputs: tuple[str, ...] = OUTPUTS) -> list[pa.Array]:
    """The counts and the chosen outputs of ``align_tokens`` for some texts."""
    ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    stops: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    counts = np.zeros((3, len(texts)), np.int64)  # tokens of either side, groups

    def work(words: list[str], document: np.ndarray) -> None:
        found, whole = pairs.look_up(words)
        broken.update(document[~whole].tolist())
        (left, n), (right, m) = found
        keep = ~np.isin(document, list(broken))
        left, right = left[np.repeat(keep, n)], right[np.repeat(keep, m)]
        n, m, own = n[keep], m[keep], document[keep]
        if not len(own):
            return
        ends = np.cumsum(pairs.length_of[0][left]), np.cumsum(pairs.length_of[1][right])
        at = common_ends(*ends, (n, m), own)
        for side in (0, 1):
            stops[side].append(at[side] + 1 + sum(map(len, ids[side])))
        group_owner = own[np.searchsorted(np.cumsum(n), at[0], "right")]
        ids[0].append(left)
        ids[1].append(right)
        for k, one in enumerate((np.repeat(own, n), np.repeat(own, m), group_owner)):
            counts[k] += np.bincount(one, minlength=len(texts))

    broken: set[int] = set()
    words: list[str] = []
    document: list[tuple[int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        if text:
            for part in text_slices(" " + text, SLICE_CHARS):
                own = pairs.words(part)
                words += own
                document.append((k, len(own)))
                size += len(part)
                if size > SLICE_CHARS:
                    work(words, np.repeat(*np.array(document).T))
                    words, document, size = [], [], 0
    if words:
        work(words, np.repeat(*np.array(document).T))
    flat = tuple(np.concatenate([np.zeros(0, np.int32), *side]) for side in ids)
    stop = tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in stops)
    if any(counts[0][k] for k in broken):  # an earlier slice of the text was aligned already
        gone = np.zeros(len(texts), bool)
        gone[list(broken)] = True
        keep_group = np.repeat(~gone, counts[2])
        keep_token = [np.repeat(~gone, counts[side]) for side in (0, 1)]
        stop = tuple(np.cumsum(keep)[s - 1][keep_group] for keep, s in zip(keep_token, stop, strict=True))
        flat = tuple(f[keep] for f, keep in zip(flat, keep_token, strict=True))
        counts[:, gone] = 0
    makers = {
        "a_ids": lambda: (counts[0], flat[0]), "b_ids": lambda: (counts[1], flat[1]),
        "a_stops": lambda: (counts[2], stop[0] - np.repeat(_starts(counts[0])[:-1], counts[2])),
        "b_stops": lambda: (counts[2], stop[1] - np.repeat(_starts(counts[1])[:-1], counts[2])),
        "a_links": lambda: (counts[2], flat[0][stop[0] - 1]), "b_links": lambda: (counts[2], flat[1][stop[1] - 1]),
    }
    columns: list[pa.Array] = [pa.array(c) for c in counts]
    for name in outputs:
        if name == "groups":
            columns.append(pa.array(_group_text(flat, stop, counts[2]), pa.binary()).cast(pa.string()))
        else:
            n, values = makers[name]()
            columns.append(pa.ListArray.from_arrays(pa.array(_starts(n), pa.int32()), pa.array(values, pa.int32())))
    return columns


_loaded: dict[tuple[str, str], TokenPairs] = {}
_INTS = T.ArrayType(T.IntegerType(), False)


def align_tokens(
    documents: DataFrame, byte_level_path: str, piece_path: str, outputs: tuple[str, ...] = OUTPUTS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, and those of ``OUTPUTS`` that are asked for) per row.

    Side a is a byte-level tokenizer on a blank and the text, side b a piece tokenizer (which sets the
    blank itself) on the text. Group g holds the tokens from the stops of the group before it up to
    ``a_stops[g]`` and ``b_stops[g]``; ``a_links`` and ``b_links`` are the two tokens that end together
    there. ``groups`` writes all ids as ``a1,a2|b1;a3|b2``. A null or empty text, and one whose
    bytes either side does not give back, has no tokens: zeros, empty arrays and text. Rows are worked on one by one: repeated rows
    and null ids give a row each, an empty table gives none. Other columns are ignored.
    """
    source = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    of_output = {c: _INTS if c in LISTS else T.StringType() for c in OUTPUTS}
    schema = T.StructType([
        source.schema["doc_id"], *[T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b", "n_groups")],
        *[T.StructField(c, of_output[c], False) for c in outputs],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = byte_level_path, piece_path
        if paths not in _loaded:
            _loaded[paths] = TokenPairs(*paths)
        for batch in batches:
            lo, size = 0, 0
            texts = batch.column(1).to_pylist()
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1] or "") + 64
                if size >= SLICE_CHARS or hi == len(texts):
                    found = align_part(_loaded[paths], texts[lo:hi], outputs)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *found], names=schema.names)
                    lo, size = hi, 0

    return source.mapInArrow(run, schema)


def coded_links(aligned: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """``aligned`` with (part, codes, pairs) in place of ``a_links`` and ``b_links``.

    Rows are taken in parts of about ``part_links`` links. ``codes`` numbers a row's links in the list of
    their part's distinct id pairs, in two bytes each (four where the list is longer than that allows);
    the list stands in ``pairs`` of the part's first row, each pair with its number of links, and is null
    in the others.
    """
    others = [c for c in aligned.columns if c not in ("a_links", "b_links")]
    pair = T.StructType([T.StructField("a_id", T.IntegerType()), T.StructField("b_id", T.IntegerType()), T.StructField("n", T.LongType())])
    schema = T.StructType([
        *[aligned.schema[c] for c in others], T.StructField("part", T.LongType(), False),
        T.StructField("codes", T.BinaryType(), False), T.StructField("pairs", T.ArrayType(pair)),
    ])

    def coded(rows: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        links = [rows.column(c).combine_chunks() for c in ("a_links", "b_links")]
        stop = np.cumsum(links[0].value_lengths().to_numpy())
        both = links[0].flatten().to_numpy().astype(np.int64) << 32 | links[1].flatten().to_numpy()
        known, code, n = np.unique(both, return_inverse=True, return_counts=True)
        written = code.astype(_code_type(len(known))).tobytes()
        width = len(written) // max(1, len(code))
        codes = [written[width * lo : width * hi] for lo, hi in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        listed = pa.StructArray.from_arrays(
            [pa.array((known >> 32).astype(np.int32)), pa.array((known & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a_id", "b_id", "n"]
        )
        offsets = pa.array([0] + [len(known)] * len(codes), pa.int32())
        mask = pa.array([False] + [True] * (len(codes) - 1))
        columns = [*[rows.column(c) for c in others], pa.array([part] * len(codes), pa.int64()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, listed, mask=mask)]
        yield from pa.table(columns, names=schema.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            weight = batch.column(batch.schema.get_field_index("a_links")).value_lengths().to_numpy().astype(np.int64) + 1
            while batch.num_rows:
                total = size + np.cumsum(weight)
                take = int(np.searchsorted(total, part_links)) + 1  # up to the row that fills the part
                held.append(batch.slice(0, take))
                size = int(total[min(take, len(total)) - 1])
                batch, weight = batch.slice(take), weight[take:]
                if size >= part_links:
                    yield from coded(pa.Table.from_batches(held), part)
                    part, held, size = part + 1, [], 0
        if held:
            yield from coded(pa.Table.from_batches(held), part)

    return aligned.mapInArrow(run, schema)


def _code_type(pairs: int) -> type:
    return np.uint16 if pairs <= 1 << 16 else np.uint32


def score_links(coded: DataFrame) -> DataFrame:
    """The rows of a written ``coded_links`` without part, codes and pairs, with (n_links, n_best, count_sum).

    A pair's count is the number of links that hold it in the whole table. ``n_best`` counts the links
    whose count is the highest of their b id, ``count_sum`` sums the counts over links. Each part asks
    once for each of its pairs, so that the join meets pairs of parts and not links.
    """
    asked = coded.where("pairs is not null").select("part", F.posexplode("pairs").alias("code", "pair")).select("part", "code", "pair.*")
    total = asked.groupBy("a_id", "b_id").agg(F.sum("n").alias("total"))
    highest = total.groupBy("b_id").agg(F.max("total").alias("highest"))
    best = total.join(highest, "b_id").select("a_id", "b_id", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = asked.join(best, ["a_id", "b_id"]).select(F.col("part").alias("to"), "code", "total", "best")
    others = [c for c in coded.columns if c not in ("part", "codes", "pairs")]
    schema = T.StructType([*[coded.schema[c] for c in others], *[T.StructField(c, T.LongType(), False) for c in ("n_links", "n_best", "count_sum")]])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("code")
        kind = _code_type(known.num_rows)
        codes = [np.frombuffer(c, kind) for c in rows.column("codes").to_pylist()]
        total, best = known.column("total").to_numpy(), known.column("best").to_numpy()
        sums = [[len(c) for c in codes], [int(best[c].sum()) for c in codes], [int(total[c].sum()) for c in codes]]
        return pa.table([*[rows.column(c) for c in others], *[pa.array(x, pa.int64()) for x in sums]], names=schema.names)

    return coded.select("part", "codes", *others).groupBy("part").cogroup(answers.groupBy("to")).applyInArrow(run, schema)
