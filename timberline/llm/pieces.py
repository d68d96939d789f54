"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

Texts are cut where no piece can span (before a space mark that follows another character, and around characters
that only occur alone), so equal words are encoded once per batch. All words not seen before lie in one flat
symbol array. A round finds the best pair of each word (highest score, a segmented minimum of ranks), merges its
occurrences from the left, and compacts the array; words without a pair leave it. A merge is risky if a pair that it
makes ranks as high as it: the one-at-a-time definition would take that pair next. So a word's merges are done at once
up to its first risky one; from there a front goes on to the right, in all such words in step, and the word's other
merges wait for the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

SPACE = "▁"
NONE = np.int64(1 << 40)
#: Words that a task remembers with their ids, and the longest of them.
MEMORY, LONGEST = 400_000, 64


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix; begin and end ids are added."""

    def __init__(self, model: bytes):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = read.vocab_size()
        self.pieces = [read.id_to_piece(i) for i in range(n)]
        self.begin, self.end = read.bos_id(), read.eos_id()
        special = [read.is_control(i) or read.is_unknown(i) for i in range(n)]
        byte = [read.is_byte(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self.byte_ids = np.array([read.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if not all(byte[i] for i in self.byte_ids):
            raise ValueError("a model without byte fallback is not supported")
        # symbols: ids of pieces, then characters that occur in pieces only
        letters = sorted({c for p in plain for c in p} - plain.keys())
        self.symbol = {c: i for c, i in plain.items() if len(c) == 1} | {c: n + k for k, c in enumerate(letters)}
        self.symbols, self.n = n + len(letters) + 1, n
        score = {i: read.get_score(i) for i in plain.values()}
        ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        known = plain | {c: i for c, i in self.symbol.items()}
        pairs = [
            (known[p[:k]] * self.symbols + known[p[k:]], ranks[score[i]], i)
            for p, i in plain.items()
            for k in range(1, len(p))
            if p[:k] in known and p[k:] in known
        ]
        pairs.sort()
        self.key, self.rank, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.text = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.text_end = np.cumsum(self.sizes)
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        joined = {c for p in plain if len(p) > 1 for c in p}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain):
            self.cut = None  # spaces inside pieces: a text is one word
        else:
            alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in joined)
            self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart; together they are the text with space marks."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        return self.cut.findall(marked) if self.cut else [marked] if marked else []

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[at] == key
        return np.where(found, self.rank[at], NONE), np.where(found, self.made[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each word has."""
        unknown = self.symbols - 1
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        different, place = np.unique(letters, return_inverse=True)
        symbol = np.array([self.symbol.get(chr(c), unknown) for c in different], np.int64)[place] if len(letters) else np.zeros(0, np.int64)
        letter = letters.astype(np.int64)  # of symbols that are still single characters
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_symbol, done_letter = [], [], []
        rank, made = self._pair_ranks(symbol, np.r_[symbol[1:], 0])
        rank[:-1][word[1:] != word[:-1]] = NONE
        rank[-1:] = NONE
        while len(symbol):
            last = np.r_[word[1:] != word[:-1], True]
            start = np.flatnonzero(np.r_[True, last[:-1]])
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(word)])
            over = best == NONE
            if over.any():
                stay = np.repeat(~over, size)
                for done, x in ((done_word, word), (done_symbol, symbol), (done_letter, letter)):
                    done.append(x[~stay])
                symbol, letter, word, rank, made = (x[stay] for x in (symbol, letter, word, rank, made))
                best, size = best[~over], size[~over]
                if not len(symbol):
                    break
                start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(size)), size)
            pick = np.flatnonzero(rank == best[owner])
            fresh = np.r_[True, (pick[1:] != pick[:-1] + 1)]  # of a run of neighbours, every other one
            run = np.flatnonzero(fresh)
            pick = pick[(np.arange(len(pick)) - np.repeat(run, np.diff(np.r_[run, len(pick)]))) % 2 == 0]
            first = np.r_[True, owner[pick][1:] != owner[pick][:-1]]
            risky = self._risky(symbol, owner, pick, made[pick], best[owner[pick]])
            # of a word's merges, those up to its first risky one are done, and from there a front goes on alone
            some, at = np.unique(owner[pick[risky]], return_index=True)
            front = np.flatnonzero(risky)[at]
            bar = np.full(len(size), len(pick))
            bar[some] = front
            pick = pick[np.arange(len(pick)) <= bar[owner[pick]]]
            symbol[pick] = made[pick]
            stay = np.ones(len(symbol), bool)
            stay[pick + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[pick] = True
            if len(some):
                touched[np.isin(owner, some)] = True
                last_pick = np.searchsorted(owner[pick], some, side="right") - 1
                self._advance(symbol, stay, pick[last_pick], start[some], start[some] + size[some], best[some])
            symbol, letter, word, rank, made, touched = (x[stay] for x in (symbol, letter, word, rank, made, touched))
            # only pairs that a merged symbol is part of have changed
            at = np.flatnonzero(touched | np.r_[touched[1:], False])
            after = np.minimum(at + 1, len(symbol) - 1)
            rank[at], made[at] = self._pair_ranks(symbol[at], symbol[after])
            rank[at[(word[after] != word[at]) | (after == at)]] = NONE
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbol, letter = (np.concatenate(x) for x in (done_word, done_symbol, done_letter))
        order = np.argsort(word, kind="stable")
        return self._with_bytes(word[order], symbol[order], letter[order], len(words))

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray, letter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: characters that are no pieces become the ids of their bytes."""
        size = np.ones(len(symbol), np.int64)
        bare = np.flatnonzero(symbol >= self.n)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in letter[bare].tolist()]
        size[bare] = [len(b) for b in spelled]
        ids = np.repeat(symbol, size)
        if len(bare):
            in_bytes = np.repeat(symbol >= self.n, size)
            ids[in_bytes] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(word, size, minlength=n).astype(np.int64)

    def _risky(self, symbol, owner, pick, made, rank) -> np.ndarray:
        """Merges that make a pair, with a neighbour as it is or as it will be, of no lower place than the pair."""
        after = symbol.copy()
        after[pick] = made
        merged = np.zeros(len(symbol), bool)
        merged[pick] = True
        right, left = np.minimum(pick + 2, len(symbol) - 1), np.maximum(pick - 1, 0)
        before = np.maximum(pick - 2, 0)
        has_right = (pick + 2 < len(symbol)) & (owner[right] == owner[pick])
        has_left = (pick > 0) & (owner[left] == owner[pick])
        twice = (pick > 1) & merged[before] & has_left
        risky = np.zeros(len(pick), bool)
        for other, there, forward in ((symbol[right], has_right, True), (after[right], has_right, True), (symbol[left], has_left, False), (after[before], twice, False)):
            found, _ = self._pair_ranks(*((made, other) if forward else (other, made)))
            risky |= there & (found <= rank)
        return risky

    def _advance(self, symbol, stay, at, begin, end, rank) -> None:
        """Merges on, in one word each, from a merge just made at ``at``, as long as the next merge of the
        one-at-a-time order (best rank, then leftmost) is at or beside it. All pairs but those of the merged symbol
        are of ``rank`` or worse, and those of ``rank`` are to its right."""
        left = np.r_[-1, np.maximum.accumulate(np.where(stay, np.arange(len(stay)), -1))[:-1]]  # the symbol before
        after, top = at + 2, len(symbol) - 1
        while n := len(at):
            side = left[at]
            ranks, made = self._pair_ranks(np.r_[symbol[side], symbol[at]], np.r_[symbol[at], symbol[np.minimum(after, top)]])
            back, forth = np.where(side >= begin, ranks[:n], NONE), np.where(after < end, ranks[n:], NONE)
            fall = (back <= rank) & (back <= forth)
            grow = ~fall & (forth <= rank)
            live = fall | grow
            if fall.any():
                stay[at[fall]] = False
                symbol[side[fall]] = made[:n][fall]
                at = np.where(fall, side, at)
            if grow.any():
                symbol[at[grow]] = made[n:][grow]
                stay[after[grow]] = False
            after = after + grow
            if not live.all():
                next_, new = self._pair_ranks(symbol[np.minimum(after, top)], symbol[np.minimum(after + 1, top)])
                step = ~live & (after + 1 < end) & (next_ == rank)
                symbol[after[step]] = new[step]
                stay[after[step] + 1] = False
                left[after[step]] = at[step]
                at = np.where(step, after, at)
                after = after + 2 * step
                live |= step
                if not live.all():
                    at, after, begin, end, rank = (x[live] for x in (at, after, begin, end, rank))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, the dummy prefix included."""
        end = self.text_end[ids]
        start = np.where(ids > 0, self.text_end[ids - 1], 0)
        size = end - start
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.text_bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD, the dummy prefix goes."""
        data = self.decode_bytes(np.asarray(ids, np.int64))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Memory:
    """The encoded form, as bytes, and the decoded bytes of words met before; emptied when full."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ids, self.bytes = pieces, {}, {}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > MEMORY:
            self.ids.clear()
            self.bytes.clear()
        new = [w for w in words if w not in self.ids]
        if new:
            ids, size = self.pieces.encode_words(new)
            packed, text = ids.astype("<u4").tobytes(), self.pieces.decode_bytes(ids)
            end = np.cumsum(size)
            text_end = np.r_[0, np.cumsum(self.pieces.sizes[ids])][np.r_[0, end]].tolist()
            ends = np.r_[0, end * 4].tolist()
            for k, w in enumerate(new):
                self.ids[w] = packed[ends[k] : ends[k + 1]]
                self.bytes[w] = text[text_end[k] : text_end[k + 1]]

    def forget(self, words: set[str]) -> None:
        for w in words:
            if len(w) > LONGEST:
                self.ids.pop(w, None)
                self.bytes.pop(w, None)


def check_model(model: bytes) -> None:
    """Refuses models that normalise texts, or that are not encoded as the library does (such as unigram models)."""
    import sentencepiece

    library, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model)
    letters = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) != SPACE)
    if library.normalize(letters) != SPACE + letters.replace(" ", SPACE):
        raise ValueError("a model with normalisation rules is not supported")
    known = [p.replace(SPACE, " ") for p in pieces.pieces[:: max(1, pieces.n // 2000)]]
    sample = "".join(known) + " ".join(known) + " " * 70
    ids, _ = pieces.encode_words(pieces.words(sample))
    if ids.tolist() != library.encode(sample):
        raise ValueError("not a BPE model of the supported kind")


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", decode: bool = True) -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit, begin and end included) and decoded, the text that the ids
    stand for, to every row; input columns of these names give way.

    Null texts count as empty, whose ids are begin and end alone. ``model`` is the content of a SentencePiece model
    file: BPE with byte fallback, no normalisation rules, a dummy prefix and no removal of spaces; others are refused.
    Repeated rows all stay and are encoded alike, other columns stay, an empty table gives no rows. A text is held whole in
    one task; one without any space is a single word, merged in as many rounds as it needs, and a run of a million
    spaces takes about a minute.
    """
    check_model(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("ids", "decoded")]
    packed = docs.select(F.struct(*names).alias("rest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType(
        [
            StructField("rest", packed.schema["rest"].dataType),
            StructField("ids", BinaryType()),
            StructField("decoded", StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        memory = Memory(pieces)
        begin, end = (np.array([i], "<u4").tobytes() for i in (pieces.begin, pieces.end))
        for batch in batches:
            texts = batch.column("text")
            first = 0
            while first < len(texts):
                parts, size, last = [], 0, first
                while last < len(texts) and (size < 1 << 20 or last == first):
                    parts.append(pieces.words(texts[last].as_py()))
                    size += sum(map(len, parts[-1]))
                    last += 1
                needed = set().union(*parts)
                memory.learn(needed)
                ids = [b"".join([begin, *map(memory.ids.__getitem__, p), end]) for p in parts]
                decoded = [b"".join(map(memory.bytes.__getitem__, p))[1:].decode("utf-8", "replace") for p in parts] if decode else [None] * len(parts)
                memory.forget(needed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rest").slice(first, last - first), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    ["rest", "ids", "decoded"],
                )
                first = last

    return packed.mapInArrow(run, schema).select("rest.*", "ids", "decoded")


def decode_pieces(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, the text of the packed ids of each row; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    packed = rows.drop("decoded").select(F.struct(*[c for c in rows.columns if c != "decoded"]).alias("rest"), F.col(ids_col).alias("ids"))
    schema = StructType([StructField("rest", packed.schema["rest"].dataType), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x.as_py(), "<u4")) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "decoded"])

    return packed.mapInArrow(run, schema).select("rest.*", "decoded")
