"""Quality classifier: interpolated modified Kneser-Ney character n-grams of trusted text.

One model per language. Trusted documents are those labelled with quality 1 (and never 0). Half of
the hashes of their doc_ids train the models, whole texts, however many there are; the
others set the thresholds. A document is accepted
if its perplexity is at most its language's ``quantile`` over those.

Training counts are sharded by n-gram: n-gram counts, continuation counts, context totals and
lower orders meet in shuffled joins, which give each n-gram's probability and each context's
weight. Scoring is a join with these shards too. Documents are dealt to blocks; a block asks for its distinct
n-grams once, the shards answer every distinct n-gram of the corpus once, backing off order by order, and the
answers go back to the blocks as files in the shared folder, which the scoring tasks read. So no table
of the model is gathered or broadcast, texts are not shuffled, and what moves is a block's distinct n-grams.

An n-gram is a 64-bit number, sixteen bits a symbol. A language's symbols are the characters of its training text by
frequency: all of them, up to the 65,534 that sixteen bits can name (further ones would count as unknown characters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.runtime import discard, new_path, stash

BITS = 16
MOST_LETTERS = (1 << BITS) - 2  # symbol 0 pads the start, symbol 1 is any other character
ORDER = 4
CODE_POINTS = 0x110000
STEP = 0.001  # nats; thresholds are exact quantiles of perplexities on this grid
COARSE = 64  # steps in a coarse step, by which the grid is searched
SPLIT = 4096
#: Characters, and n-grams, that a task holds as numbers at once.
RUN = 1 << 20
#: Odd multipliers of the hash tables.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def lookup(letters: list[str]) -> np.ndarray:
    """Symbol of every code point."""
    table = np.ones(CODE_POINTS, np.uint16)
    for i, c in enumerate(letters):
        table[ord(c)] = i + 2
    return table


def keys(text: str, alphabet: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """n-gram of every character, the last symbol lowest, in runs of RUN at most; paddings before the text."""
    for a in range(0, len(text), RUN):
        lead = max(0, a - order + 1)
        cp = np.frombuffer(text[lead : a + RUN].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.zeros(min(RUN, len(text) - a) + order - 1, np.uint64)
        s[len(s) - len(cp) :] = alphabet[cp]
        n = len(s) - order + 1
        out = s[:n].copy()
        for i in range(1, order):
            out <<= np.uint64(BITS)
            out |= s[i : i + n]
        yield out.view(np.int64)


def slots(k: np.ndarray, mix: int, bits: int) -> np.ndarray:
    return ((k.view(np.uint64) * np.uint64(mix)) >> np.uint64(64 - bits)).view(np.int64)


class Distinct:
    """The distinct keys put in. A direct-mapped table lets repeats of common keys go at once."""

    def __init__(self, bits: int = 18):
        self.bits, self.table, self.parts, self.held = bits, np.zeros(1 << bits, np.int64), [], 0

    def put(self, k: np.ndarray) -> None:
        new = k[self.table[slots(k, MIX[0], self.bits)] != k]
        if len(new):
            new = np.unique(new)
            self.table[slots(new, MIX[0], self.bits)] = new
            self.parts.append(new)
            self.held += len(new)
            if self.held > 4 * RUN:
                self.parts = [self.all()]
                self.held = len(self.parts[0]) // 2  # merged again only after as much has come in

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)


class Probes:
    """Values of int64 keys: direct-mapped tables one after the other, then a sorted rest."""

    def __init__(self, k: np.ndarray, values: np.ndarray):
        self.bits, self.tables = max(8, (2 * len(k)).bit_length()), []
        for mix in MIX:
            at, own = slots(k, mix, self.bits), np.arange(len(k))
            place = np.full(1 << self.bits, -1)
            place[at] = own
            won = place[at] == own
            keys_, vals = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.float64)
            keys_[at[won]], vals[at[won]] = k[won], values[won]
            self.tables.append((mix, keys_, vals))
            k, values = k[~won], values[~won]
        order = np.argsort(k)
        self.rest, self.values = k[order], values[order]

    def total(self, k: np.ndarray) -> float:
        """Sum of the keys' values; an unknown key raises."""
        out = 0.0
        for mix, keys_, vals in self.tables:
            at = slots(k, mix, self.bits)
            hit = keys_[at] == k
            out += float(vals[at[hit]].sum())
            k = k[~hit]
            if not len(k):
                return out
        at = np.searchsorted(self.rest, k)
        if not len(self.rest) or (self.rest[np.minimum(at, len(self.rest) - 1)] != k).any():
            raise KeyError("an n-gram that its block did not ask for")
        return out + float(self.values[at].sum())


@dataclass
class Model:
    """Sharded tables and the letters of each language."""

    letters: dict[str, list[str]]
    #: of each k: lang, key, ctx, p, g; p is the probability of a seen k-gram, g the weight that its context leaves to order k - 1
    grams: dict[int, DataFrame]
    order: int = ORDER

    def floor(self) -> Column:
        """Probability that a language gives every character before anything is counted."""
        return F.create_map(*[x for lang, c in self.letters.items() for x in (F.lit(lang), F.lit(1.0 / (len(c) + 1)))])[F.col("lang")]


def language(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("und")) if "lang" in df.columns else F.lit("und")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose every label says quality 1."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.col("quality").isNull()).alias("x")).where("q = 1 and not x").select("doc_id")


def draw(key: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.lit(41), F.col(key)), F.lit(SPLIT)).cast("int")


def training_cut(trusted_texts: DataFrame) -> DataFrame:
    """(lang, upto, since): trusted texts of hash below ``upto`` train, those of hash ``since`` or more set the threshold.

    Both are the middle of the hashes, moved where that would leave one side without texts. If all texts
    of a language have the same hash they do both.
    """
    ends = trusted_texts.groupBy("lang").agg(F.min(draw()).alias("lo"), F.max(draw()).alias("hi"))
    middle = F.least(F.greatest(F.lit(SPLIT // 2), F.col("lo") + 1), F.greatest("hi", F.col("lo") + 1))
    return ends.select("lang", middle.alias("upto"), F.least(middle, "hi").alias("since"))


def symbols_below(key: Column, k: int) -> Column:
    """The last ``k`` symbols of a key."""
    return key.bitwiseAND(F.lit((1 << BITS * k) - 1)) if BITS * k < 64 else key


def context_of(key: Column) -> Column:
    return F.call_function("shiftrightunsigned", key, F.lit(BITS))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Model of (lang, text). Null and empty texts teach nothing."""
    texts = texts.where("length(text) > 0").select("lang", "text")

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                cp = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                n = np.bincount(cp)
                have = seen.get(lang, np.zeros(0, np.int64))
                if len(have) < len(n):
                    have, n = n, have
                have[: len(n)] += n
                seen[lang] = have
        for lang, n in seen.items():
            c = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c, pa.int64()), pa.array(n[c], pa.int64())], names=["lang", "c", "n"])

    counted = stash(texts.mapInArrow(letters_of, "lang string, c long, n long").groupBy("lang", "c").agg(F.sum("n").alias("n")), "letters")
    letters: dict[str, list[str]] = {}
    for r in counted.orderBy("lang", F.desc("n"), "c").collect():  # the characters of each language: bounded by Unicode
        own = letters.setdefault(r["lang"], [])
        if len(own) < MOST_LETTERS:
            own.append(chr(r["c"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n, pa.int64())], names=["lang", "key", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in tables:
                    tables[lang] = lookup(letters[lang])
                for k in keys(text.as_py(), tables[lang], order):
                    held.setdefault(lang, []).append(k)
                    size += len(k)
                    if size > 4 * RUN:
                        yield from out()
                        size = 0
        yield from out()

    counts = texts.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    levels = {order: stash(counts, "ngrams")}
    for k in range(order - 1, 0, -1):  # continuation counts: how many symbols precede
        levels[k] = levels[k + 1].groupBy("lang", symbols_below(F.col("key"), k).alias("key")).agg(F.count("*").alias("n"))
    model = Model(letters, {}, order)
    for k in range(1, order + 1):
        c = levels[k]
        kinds = c.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(i: int, y=y) -> Column:
            raw = F.lit(float(i)) - (i + 1) * y * F.coalesce(F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.0))
            return F.greatest(F.lit(0.1), F.least(raw, F.lit(i - 0.1))).alias(f"d{i}")

        ds = kinds.select("lang", *[discount(i) for i in (1, 2, 3)])  # a row per language
        c = c.join(F.broadcast(ds), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        c = c.withColumn("ctx", context_of(F.col("key")))
        ctx = c.groupBy("lang", "ctx").agg(F.sum("n").alias("t"), (F.sum("d") / F.sum("n")).alias("g"))
        own = c.join(ctx, ["lang", "ctx"])
        if k == 1:
            p = own.withColumn("lower", model.floor() if letters else F.lit(1.0))
        else:
            lower = model.grams[k - 1].select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower"))
            p = own.withColumn("suffix", symbols_below(F.col("key"), k - 1)).join(lower, ["lang", "suffix"])
        model.grams[k] = stash(p.select("lang", "key", "ctx", ((F.col("n") - F.col("d")) / F.col("t") + F.col("g") * F.col("lower")).alias("p"), "g"), f"grams{k}")
    return model


def log_probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """(lang, key, lp) of distinct n-grams (lang, key): the longest seen end of each, times the weights of the contexts above it."""
    need, out = wanted.withColumn("lp", F.lit(0.0)), None
    for k in range(model.order, 0, -1):
        key = symbols_below(F.col("key"), k)
        p = model.grams[k].select("lang", F.col("key").alias("kk"), "p")
        got = need.withColumn("kk", key).join(p, ["lang", "kk"], "left")
        got = stash(got, f"asked{k}") if k > model.order - 2 else got  # few are left after two orders
        done = got.where("p is not null").select("lang", "key", (F.col("lp") + F.log("p")).alias("lp"))
        g = model.grams[k].select("lang", F.col("ctx").alias("cc"), "g").distinct()
        need = got.where("p is null").withColumn("cc", context_of(F.col("kk"))).join(g, ["lang", "cc"], "left")
        need = need.select("lang", "key", (F.col("lp") + F.coalesce(F.log("g"), F.lit(0.0))).alias("lp"))
        out = done if out is None else out.unionByName(done)
    return out.unionByName(need.select("lang", "key", (F.col("lp") + F.log(model.floor())).alias("lp")))


def requests(blocks: DataFrame, model: Model) -> DataFrame:
    """(block, lang, key): the distinct n-grams of each block of (block, lang, text)."""
    letters, order = model.letters, model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, now = {}, None
        seen: dict[str, Distinct] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, d in seen.items():
                k = d.all()
                for a in range(0, len(k), RUN):
                    part = k[a : a + RUN]
                    yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int32()), pa.array([lang] * len(part), pa.string()), pa.array(part)], names=["block", "lang", "key"])
            seen.clear()

        for b in batches:
            for block, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if block != now:
                    yield from out()
                    now = block
                if lang in letters and (text := text.as_py()):
                    if lang not in tables:
                        tables[lang] = lookup(letters[lang])
                    if lang not in seen:
                        seen[lang] = Distinct()
                    for k in keys(text, tables[lang], order):
                        seen[lang].put(k)
        yield from out()

    return blocks.select("block", "lang", "text").mapInArrow(run, "block int, lang string, key long")


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """Stashed ``blocks`` (block, lang, text and more) with n, characters, and nll, the summed negative log-probability.

    nll is null for untaught languages and without text.
    """
    spark = blocks.sparkSession
    if not model.letters:
        return blocks.withColumns({"n": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "nll": F.lit(None).cast("double")})
    asked = stash(requests(blocks, model), "asked")
    answers = stash(log_probabilities(asked.select("lang", "key").distinct(), model), "answers")
    folder = new_path(spark, "answered")
    asked.join(answers, ["lang", "key"]).repartition("block").write.partitionBy("block").parquet(folder)
    discard(asked)
    letters, order, names = model.letters, model.order, blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        tables, now, known = {}, None, {}
        for b in batches:
            n, nll = [], []
            for block, lang, text in zip(*(b.column(names.index(c)) for c in ("block", "lang", "text"))):
                block, lang, text = block.as_py(), lang.as_py(), text.as_py()
                n.append(len(text or ""))
                if not text or lang not in letters:
                    nll.append(None)
                    continue
                if block != now:
                    got, now = pq.read_table(f"{root}/block={block}", filesystem=store, partitioning=None), block
                    whose, k, lp = (got.column(c).to_numpy() for c in ("lang", "key", "lp"))
                    known = {x: Probes(k[whose == x], lp[whose == x]) for x in set(whose)}
                if lang not in tables:
                    tables[lang] = lookup(letters[lang])
                nll.append(-sum(known[lang].total(k) for k in keys(text, tables[lang], order)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(nll, pa.float64())], names=[*names, "n", "nll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{schema}, n long, nll double")


def to_blocks(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, doc_id, lang, text, c0, c1, ...) of all documents, written once; a block is what one task wrote."""
    return stash(
        documents.select(
            F.spark_partition_id().alias("block"), "doc_id", language(documents).alias("lang"), "text",
            *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
        ),
        "blocks",
    )


def limits_of(held: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit): the least grid step ``b`` with at least ``quantile`` of a language's rows at or below it.

    Two rounds: the coarse step that holds it, then the steps in that. Each sees a few hundred rows a language.
    """
    hist = stash(held.groupBy("lang", "b").agg(F.count("*").alias("c")), "grid")

    def first(counts: DataFrame, before: Column) -> DataFrame:
        run = before + F.sum("c").over(W.partitionBy("lang").orderBy("x"))
        return counts.withColumn("run", run).where(F.col("run") >= quantile * F.col("all")).groupBy("lang").agg(F.min_by(F.struct("x", "c", "run"), "x").alias("r"))

    whole = hist.groupBy("lang").agg(F.sum("c").alias("all"))
    coarse = hist.groupBy("lang", F.floor(F.col("b") / COARSE).alias("x")).agg(F.sum("c").alias("c"))
    # one row a language
    at = first(coarse.join(F.broadcast(whole), "lang"), F.lit(0)).select("lang", F.col("r.x").alias("big"), (F.col("r.run") - F.col("r.c")).alias("before"))
    fine = hist.join(F.broadcast(at.join(whole, "lang")), "lang").where(F.floor(F.col("b") / COARSE) == F.col("big")).withColumn("x", F.col("b"))
    return first(fine, F.col("before")).select("lang", (F.col("r.x") * STEP).alias("limit"))


def judge(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, carry: tuple[str, ...] = ()) -> DataFrame:
    """``classify`` with the columns ``carry`` of each row as c0, c1, ..."""
    blocks = to_blocks(documents, carry)
    trusted = stash(trusted_ids(labels), "trusted")
    told = blocks.where("length(text) > 0").select("doc_id", "lang").join(trusted, "doc_id")
    cut = stash(training_cut(told), "cut")
    inside = F.broadcast(cut) if cut.count() <= 10_000 else cut  # one row a language
    sample = stash(told.join(inside, "lang").where(draw() < F.col("upto")).select("doc_id", "lang").distinct(), "sample")
    small = sample.count() * 32 <= 32 << 20
    texts = blocks.select("doc_id", "lang", "text").join(F.broadcast(sample) if small else sample, ["doc_id", "lang"], "left_semi").select("lang", "text")
    model = train(stash(texts, "train"))
    extra = [f"c{i}" for i in range(len(carry))]
    scores = score(blocks, model)
    scores = stash(scores.select("doc_id", "lang", "n", "nll", *extra), "scores")
    discard(blocks)
    mean = F.col("nll") / F.col("n")
    held = scores.where("nll is not null").select("doc_id", "lang", F.ceil(mean / STEP).alias("b"))
    held = held.join(trusted, "doc_id").join(inside, "lang").where(draw() >= F.col("since"))
    # one row a language
    return scores.join(F.broadcast(limits_of(held, quantile)), "lang", "left").select(
        "doc_id", "lang", F.col("n").alias("n_chars"), F.exp(mean).alias("perplexity"), F.exp("limit").alias("threshold"),
        ((F.col("n") > 0) & F.coalesce(mean <= F.col("limit"), F.lit(True))).alias("accepted"), *extra,
    )


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, accepted for every document.

    Null and empty texts have no perplexity and are not accepted. Documents of a language without
    trusted text can't be judged: no threshold, accepted. A null lang counts as ``und``. Repeated rows are
    judged alike. Without labels everything with text is accepted. Extra columns are
    ignored. An empty table gives an empty result.
    """
    return judge(documents, labels, quantile)


def accepted_rows(documents: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The rows of ``documents`` that ``classify`` accepts, each judged by itself, with their columns."""
    columns = documents.columns
    out = judge(documents, labels, quantile, tuple(columns)).where("accepted")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
