"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation is the one with the largest sum of the model's piece scores; only a
character that is no piece itself is spelt in byte pieces. The search keeps back
pointers of a window only: at every position, the paths that can still go on start at most one
longest piece back, and as soon as they agree on a boundary the ids before it are final.

No piece holds a word mark behind another character (checked when a model is loaded), so all
paths agree before every run of blanks, and the ids of a word with the blanks before it do not
depend on its neighbours: each distinct one of a batch is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_slices, tidy
from tidemark.llm.token_files import _gather

MARK = "▁"
#: Bytes of text whose words are encoded together.
CHUNK = 4_000_000
#: Ids decoded together.
DECODED = 250_000


class Model:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = np.full(256, -1, np.int64)
        text: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                text.append(b"")
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                text.append(piece.replace(MARK, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot spell every text")
        self.longest = max(map(len, self.id))
        usual = [s for s in self.score.values() if s > -1e8]
        self.spelt = min(usual) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece reaches over a word mark")
        # trie: character -> [id (-1: no piece ends here), score, the same one level down]
        self.trie: dict[str, list] = {}
        for p, i in self.id.items():
            level = self.trie
            for c in p[:-1]:
                level = level.setdefault(c, [-1, 0.0, {}])[2]
            level.setdefault(p[-1], [-1, 0.0, {}])[:2] = i, self.score[p]
        self.known: list[dict[str, bytes]] = [{}, {}]  # words without and with a mark
        self.older: list[dict[str, bytes]] = [{}, {}]  # those of the half before
        # ASCII marks that no piece holds behind a letter: all paths agree between a letter and one of them
        joined = {b for p in self.id for a, b in zip(p, p[1:]) if a.isalpha()}
        cuts = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        self.tail = rf"(\pL)[{re.escape(cuts)}][!-/:-@\[-`{{-~]*$" if cuts else r"$^"
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.sizes = np.fromiter(map(len, text), np.int64, n)
        self.first = np.cumsum(self.sizes) - self.sizes

    def spell(self, character: str) -> list[int]:
        return [int(self.byte_id[b]) for b in character.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Stream:
    """Viterbi over characters that arrive one after another.

    ``push`` takes some more characters and returns the ids that have become final, ``finish`` the rest. ``window`` is the
    number of characters that are not final yet. With equal sums the longer last piece wins.
    """

    def __init__(self, model: Model):
        self.model = model
        self.best = [0.0]
        self.back = [0]
        self.ids: list[int | list[int]] = [0]
        self.open: list[tuple[int, dict]] = []  # boundaries whose characters so far start a longer piece, and how it can go on

    @property
    def window(self) -> int:
        return len(self.best) - 1

    def push(self, characters: str, literal: bool = True) -> list[int]:
        """``literal``: word marks among the characters stand in the text itself and are spelt, so that they come back."""
        trie, spelt, limit = self.model.trie, self.model.spelt, 2 * self.model.longest
        best, back, ids, opened = self.best, self.back, self.ids, self.open
        final: list[int] = []
        here = len(best) - 1
        for character in characters:
            alone = None if literal and character == MARK else trie.get(character)
            still = []
            begin_of = here
            if alone is None or alone[0] < 0:
                top, own = best[here] + spelt, -1
            else:
                top, own = best[here] + alone[1], alone[0]
            if alone is not None:
                for begin, level in opened:
                    found = level.get(character)
                    if found is not None:
                        if found[0] >= 0:
                            total = best[begin] + found[1]
                            if total > top or (total == top and begin_of == here):
                                top, begin_of, own = total, begin, found[0]
                        if found[2]:
                            still.append((begin, found[2]))
                if alone[2]:
                    still.append((here, alone[2]))
            opened = still
            best.append(top)
            back.append(begin_of)
            ids.append(self.model.spell(character) if own < 0 else own)
            here += 1
            if not opened or here > limit:
                self.open = opened
                final += self._settle()
                best, back, ids, opened = self.best, self.back, self.ids, self.open
                here = len(best) - 1
        self.open = opened
        return final

    def _settle(self) -> list[int]:
        """Ids before the last boundary on which all paths that can go on agree."""
        heads = {len(self.best) - 1, *(b for b, _ in self.open)}
        while len(heads) > 1:  # the furthest boundary is replaced by the one before it until all are one
            far = max(heads)
            heads.remove(far)
            heads.add(self.back[far])
        return self._cut(heads.pop())

    def _cut(self, at: int) -> list[int]:
        if not at:
            return []
        parts = []
        i = at
        while i:
            parts.append(self.ids[i])
            i = self.back[i]
        base = self.best[at]
        self.best = [b - base for b in self.best[at:]]
        self.back = [0] + [b - at for b in self.back[at + 1 :]]
        self.ids = [0] + self.ids[at + 1 :]
        self.open = [(b - at, s) for b, s in self.open]
        out: list[int] = []
        for own in reversed(parts):
            if isinstance(own, list):
                out += own
            else:
                out.append(own)
        return out

    def finish(self) -> list[int]:
        self.open = []
        return self._cut(len(self.best) - 1)


def encode_word(model: Model, word: str, blanks: int = 1) -> list[int]:
    """Ids of word marks and the word behind them."""
    stream = Stream(model)
    return stream.push(MARK * blanks, False) + stream.push(word) + stream.finish()


#: Distinct words that a worker remembers, in two halves: a full half replaces the older one, and words met again move over.
REMEMBERED = 200_000


def _packed(model: Model, word: str, blanks: int = 1) -> bytes:
    """``encode_word`` as 32-bit integers, remembered over batches and tasks of a worker."""
    if blanks > 1 or len(word) > 32:
        return np.array(encode_word(model, word, blanks), np.int32).tobytes()
    known = model.known[blanks]
    found = known.get(word)
    if found is None:
        found = model.older[blanks].get(word)
        if found is None:
            found = np.array(encode_word(model, word, blanks), np.int32).tobytes()
        if len(known) >= REMEMBERED // 2:
            model.older[blanks], model.known[blanks] = known, (known := {})
        known[word] = found
    return found


def encode_column(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, flat, and their number in each text. A null or empty text has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    starts = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten().dictionary_encode()
    codes = np.asarray(flat.indices).astype(np.int64)
    words = flat.dictionary.to_pylist()
    cores = pc.replace_substring_regex(flat.dictionary, model.tail, r"\1").to_pylist()
    lists = [_packed(model, c) if len(c) == len(w) else _packed(model, c) + _packed(model, w[len(c) :], 0) for w, c in zip(words, cores)]
    void = codes == words.index("") if "" in words else np.zeros(len(codes), bool)
    last = np.zeros(len(codes), bool)
    last[starts[1:] - 1] = True
    # an empty string stands for one more blank before the next word, or at the text's end
    carrier = np.flatnonzero(~void | last)
    text = np.searchsorted(starts, carrier, "right") - 1
    before = np.maximum(np.concatenate([[-1], carrier[:-1]]) if len(carrier) else carrier, starts[text] - 1)
    more = carrier - before - 1
    pick = codes[carrier]
    runs: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(more):
        key = (int(pick[i]), int(more[i]))
        if key not in runs:
            runs[key] = len(lists)
            lists.append(_packed(model, words[key[0]], key[1] + 1))
        pick[i] = runs[key]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    ids = np.frombuffer(b"".join(lists), np.int32)
    empty = np.diff(starts) == 1
    empty &= void[starts[:-1]]
    kept = ~empty[text]
    out = _gather(ids, np.cumsum(sizes) - sizes, sizes, pick[kept])
    return out, np.bincount(text[kept], sizes[pick[kept]], len(texts)).astype(np.int64)


def decode_flat(ids: np.ndarray, sizes: np.ndarray, model: Model) -> list[str]:
    """Texts of runs of ids; the blank that every text's first piece carries is taken off."""
    ends = np.concatenate([[0], np.cumsum(model.sizes[ids])])
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
    raw = b"".join(_gather(model.flat, model.first, model.sizes, ids[k : k + DECODED]).tobytes() for k in range(0, len(ids), DECODED))
    return [raw[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode(docs: DataFrame, model_path: str, text: str = "text", name: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the piece ids (array of int) of every whole text. No shuffle.

    With ``check`` a column of that name says whether the ids, decoded at once, give the text back. A null or empty
    text has no ids. Repeated rows get equal ids; columns that have the names are replaced; an empty table stays empty.
    """
    kept = docs.drop(name, *([check] if check else []))
    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for a, b in byte_slices(whole.column(whole.schema.get_field_index(text)), CHUNK):
                batch = whole.slice(a, b - a)
                texts = batch.column(batch.schema.get_field_index(text))
                ids, n = encode_column(texts, model)
                added = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))]
                if check:
                    same = [x == (y or "") for x, y in zip(decode_flat(ids, n, model), texts.to_pylist())]
                    added.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f.name for f in fields]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text that ids spell (null ids: an empty one). No shuffle."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            texts = decode_flat(np.asarray(lists.flatten()), n, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def digest(ids: Column) -> Column:
    """Unsigned crc32 of ids written as text with commas; a check of a whole id list in SQL functions."""
    return F.crc32(F.array_join(ids, ",").cast("binary"))
