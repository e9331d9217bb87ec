"""Byte-level byte-pair training: the merges of a vocabulary, learnt from word counts that stay in Spark.

Texts are cut at white space and what lies between is counted, so the byte-level pattern runs once for each distinct run. Words
are spelt in its alphabet of 256 letters, a letter a byte. Distinct words and their counts are the state: each is a string with
a character per token, so that a merge is a replacement of two characters by one. Pair counts are a table of their own and are
kept up to date by what a round changes: only words that hold a pair to be merged give counts to take away and to add.

A round applies as many merges as one at a time would give in that order. The most frequent pairs come to the driver, a
bounded number; of these, from the top, the ones are taken that share no token with each other and above whose count no
other pair touches their tokens. A merge then neither changes the counts of the others nor makes a pair that would come
before them: a new pair is at most as frequent as one that touched the merged tokens. A merge that spells a token there
already is, so that its pairs may grow, ends its round. Pair counts are written to the shared folder between rounds, words
once in PENDING merges; in between these are made anew in each round, which reads less than the words in their tables.

Pairs of one count are taken in the order of their tokens' ids: special tokens first, then the alphabet in the order of its
letters, then merged tokens as they came. Training ends at the vocabulary's size or below the least count.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.shared import drop_table, table

# The byte-level pattern and the special tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>", "<|padding|>", "<|user|>", "<|assistant|>", "<|system|>")
#: The pattern's white space. It goes with what follows it, so a text cut before white space gives the same words in parts.
SPACE = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
CUT = "(?<=[^{0}])(?=[{0}])".format("".join(SPACE))

TOP, PENDING = 1024, 64
#: lossless() keeps what becomes of so many words of up to so many characters.
KNOWN, SHORT = 500_000, 64


@functools.cache
def alphabet() -> list[str]:
    """The letter of each byte: printable ones are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a batch of runs in the alphabet, with their counts."""
    find, letters = regex.compile(PATTERN).findall, alphabet()
    for batch in batches:
        counts: dict[str, int] = {}
        for run, n in zip(batch["run"].to_pylist(), batch["n"].to_pylist(), strict=True):
            # most runs are one word of plain letters
            for w in (run,) if run.isascii() and run.removeprefix(" ").isalpha() else find(run):
                counts[w] = counts.get(w, 0) + n
        words = ["".join([letters[b] for b in w.encode()]) if not w.isascii() or not w.removeprefix(" ").isalpha() else w.replace(" ", letters[32]) for w in counts]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of byte-level words."""
    text = F.col(text_col).cast("string")
    odd = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(c + " ")) for c in SPACE])
    # a cut at every space is faster, but wrong within white space; _outer: the plain form would cut each text twice
    cut = df.select(odd.alias("odd"), F.when(odd, F.split(text, CUT)).otherwise(F.split(text, " ")).alias("parts"))
    parts = cut.select("odd", F.posexplode_outer("parts").alias("at", "part"))
    runs = parts.where("part IS NOT NULL").select(F.when(F.col("odd") | (F.col("at") == 0), F.col("part")).otherwise(F.concat(F.lit(" "), "part")).alias("run"))
    found = runs.groupBy("run").agg(F.count("*").alias("n")).mapInArrow(_spell, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def merged(tokens: list[int], new: dict[tuple[int, int], int]) -> list[int]:
    """Tokens with every pair of new replaced, from the left. No two pairs of new share a token."""
    out, i, last = [], 0, len(tokens) - 1
    while i <= last:
        t = new.get((tokens[i], tokens[i + 1])) if i < last else None
        out.append(tokens[i] if t is None else t)
        i += 1 if t is None else 2
    return out


def character(token: int) -> str:
    """What stands for a token in a word's string; characters are ordered as ids are."""
    return chr(token + 0x100 if token + 0x100 < 0xD800 else token + 0x900)


def _replaced(word: Column, merges: list[tuple[str, str]]) -> Column:
    return functools.reduce(lambda w, m: F.replace(w, F.lit(m[0]), F.lit(m[1])), merges, word)


def _pairs(rows: DataFrame) -> DataFrame:
    """(pair, n) of words (word, n), not yet summed by pair over tasks."""
    each = F.zip_with(F.split("word", ""), F.split(F.expr("substring(word, 2)"), ""), lambda a, b: F.concat(a, b))
    return rows.select(F.explode(each).alias("pair"), "n").where("length(pair) = 2")


class Vocabulary:
    """Tokens by id, and the merges that made them."""

    def __init__(self, special: tuple[str, ...] = SPECIAL) -> None:
        self.tokens = [*special, *sorted(alphabet())]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.merges: list[tuple[str, str, int]] = []
        self._ranks: dict[tuple[str, str], int] = {}
        self.n_special, self._bytes = len(special), []

    def ranks(self) -> dict[tuple[str, str], int]:
        """When a pair was merged, by its tokens."""
        for i in range(len(self._ranks), len(self.merges)):
            self._ranks[self.merges[i][:2]] = i
        return self._ranks

    def bytes(self) -> list[bytes]:
        """What each token stands for."""
        if len(self._bytes) < len(self.tokens):
            back = {c: b for b, c in enumerate(alphabet())}
            self._bytes += [t.encode() if i < self.n_special else bytes(back[c] for c in t) for i, t in enumerate(self.tokens)][len(self._bytes) :]
        return self._bytes

    def __len__(self) -> int:
        return len(self.tokens)

    def add(self, left: int, right: int, n: int) -> int:
        token = self.tokens[left] + self.tokens[right]
        self.merges.append((self.tokens[left], self.tokens[right], n))
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]


def independent(pairs: list[tuple[int, int, int]], vocabulary: Vocabulary, whole: bool) -> list[tuple[int, int, int]]:
    """Of pairs (l, r, n) in order, the first ones that can be merged in one round. whole: pairs are all there are."""
    out, used = [], set()
    for k, (left, right, n) in enumerate(pairs):
        if out:
            if {left, right} & used:
                break
            # as frequent pairs that come later must not touch what is merged: what becomes of them could come first
            later = next((i for i in range(k, len(pairs)) if pairs[i][2] < n), None)
            if later is None and not whole:
                break
            if any({a, b} & used for a, b, _ in pairs[k:later]):
                break
        out.append((left, right, n))
        used |= {left, right}
        if vocabulary.tokens[left] + vocabulary.tokens[right] in vocabulary.ids:
            break
    return out


def train(words: DataFrame, size: int = 56_000, least: int = 2, special: tuple[str, ...] = SPECIAL, merges: int | None = None) -> Vocabulary:
    """The vocabulary of words (word, n) up to so many tokens, from pairs of at least so many occurrences; merges: at most so
    many, if given. Words are bounded by nothing but the table; the driver holds the vocabulary and TOP pairs."""
    vocabulary = Vocabulary(special)
    letters = alphabet()
    spelt = F.translate("word", "".join(letters), "".join(character(vocabulary.ids[c]) for c in letters))
    state = table(words.where("n > 0 AND word <> ''").select(spelt.alias("word"), F.col("n").cast("long").alias("n")), "words")
    counts = table(_pairs(state).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    pending: list[tuple[str, str]] = []  # merges that the words' table doesn't show yet
    tokens = {character(i): i for i in range(len(vocabulary))}
    while len(vocabulary) < size and (merges is None or len(vocabulary.merges) < merges):
        found = counts.where(F.col("n") >= max(1, least)).orderBy(F.desc("n"), "pair").limit(TOP).collect()
        top = [(tokens[r.pair[0]], tokens[r.pair[1]], r.n) for r in found]
        chosen = independent(top, vocabulary, len(top) < TOP)
        chosen = chosen[: min(PENDING, size - len(vocabulary), len(chosen) if merges is None else merges - len(vocabulary.merges))]
        if not chosen:
            break
        new = []
        for left, right, n in chosen:
            token = vocabulary.add(left, right, n)
            tokens[character(token)] = token
            new.append((character(left) + character(right), character(token)))
        if len(vocabulary) >= size or len(vocabulary.merges) == merges:
            break  # nothing asks for the pairs after the last merge
        if len(pending) + len(new) > PENDING:
            old, state = state, table(state.select(_replaced(F.col("word"), pending).alias("word"), "n"), "words")
            drop_table(old)
            pending = []
        before = state.select(_replaced(F.col("word"), pending).alias("word"), "n")
        touched = before.where(F.greatest(F.lit(False), *[F.contains("word", F.lit(p)) for p, _ in new]))
        both = F.array(F.struct("word", (-F.col("n")).alias("n")), F.struct(_replaced(F.col("word"), new).alias("word"), "n"))
        changes = _pairs(touched.select(F.inline(both)))
        now = table(counts.union(changes).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
        drop_table(counts)
        counts, pending = now, pending + new
    for old in (state, counts):
        drop_table(old)
    return vocabulary


def join_pairs(parts: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """parts with pairs merged, of the least rank first, and of one rank from the left. Pairs wait in a heap, so a word of n
    letters takes n log n steps."""
    heap = [(order[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in order]
    if not heap:
        return parts
    heapq.heapify(heap)
    n, parts = len(parts), [*parts]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j == n or (parts[i], parts[j]) != pair:
            continue  # one of the two has been merged since
        parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (p := (parts[a], parts[b])) in order:
                heapq.heappush(heap, (order[p], a, p))
    return [p for p in parts if p]


def encode(text: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of a text; its words' pairs are merged in the order in which they were learnt."""
    order, letters, out = vocabulary.ranks(), alphabet(), []
    for word in regex.findall(PATTERN, text):
        out += [vocabulary.ids[p] for p in join_pairs([letters[b] for b in word.encode()], order)]
    return out


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids; special tokens stand for themselves, and bytes that are no text become U+FFFD."""
    known = vocabulary.bytes()
    return b"".join([known[i] for i in ids]).decode(errors="replace")


def merge_table(df: DataFrame, text_col: str, merges: int) -> DataFrame:
    """(rank, left, right, n): the first merges that a column of texts gives, with how often each pair stood there."""
    found = train(word_counts(df, text_col), merges=merges).merges
    return df.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(found)], "rank long, left string, right string, n long")


def lossless(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_chars, same): for each text its tokens, its characters and whether decoding gives it back. Null
    texts count as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a word, its number of tokens and the bytes that they stand for
        known: dict[str, tuple[int, bytes]] = {}
        find, stands_for = regex.compile(PATTERN).findall, vocabulary.bytes()

        def word(w: str) -> tuple[int, bytes]:
            ids = encode(w, vocabulary)
            found = len(ids), b"".join([stands_for[i] for i in ids])
            if len(w) <= SHORT:
                if len(known) >= KNOWN:
                    known.clear()
                known[w] = found
            return found

        for batch in batches:
            n, chars, same = [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                found = [known.get(w) or word(w) for w in find(text)]
                n.append(sum([x[0] for x in found]))
                chars.append(len(text))
                same.append(b"".join([x[1] for x in found]).decode(errors="replace") == text)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(same)], ["id", "n_tokens", "n_chars", "same"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_chars long, same boolean").withColumnRenamed("id", id_col)
