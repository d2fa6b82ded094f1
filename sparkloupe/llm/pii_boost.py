"""Personal data by candidates and gradient-boosted trees, in Spark SQL expressions.

Base kinds are found by their patterns and checks, and stay. High-recall generators propose further spans, which may
overlap; boosted trees score each by features of its format and its context, and calibrated thresholds select. The
trees are fitted on places of at most `SAMPLE` base matches and `SAMPLE` other candidates of the documents, drawn by a
hash: base matches written in other ways in their own context are personal, card numbers with a wrong check digit and
numbers that no base kind holds aren't; identity and account numbers, which no base kind has, are invented and put
into contexts of the documents. A third fits the trees, a third calibrates their probabilities and thresholds, and a
third gives the figures. The same expressions compute all features; the fit has that fixed size. The main path is one
projection: trees become nested CASE expressions over a span's features, and nothing is shuffled or leaves the JVM.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spans import SPANS, guarded, joined, let

#: Base kinds in order, with patterns that match alike without growing the matcher's stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Generators of candidates, (kind, guard, pattern).
GENERATORS = (
    ("contact_like", r"(?i)\bat\b|@", r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[a-z0-9-]{2,63}){1,4}"),
    ("phone_like", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone_like", r"[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}", r"(?<![0-9])(?:\+[0-9]{2} ?)?\(?0?[0-9]{1,2}\)?(?:[ .-][0-9]{2}){4}(?![0-9])"),
    ("card_like", r"[0-9]{4}[ -]?[0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("id_like", r"[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account_like", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("number_like", r"[0-9](?:[ ./-]?[0-9]){8}", r"(?<![0-9])[0-9](?:[ ()./-]{0,2}[0-9]){8,24}(?![0-9])"),
)
KINDS = (*BASE, *dict.fromkeys(g[0] for g in GENERATORS))
FEATURES = ("generator", "digits", "length", "separators", "groups", "longest", "plus", "luhn", "contact", "identity", "joined_before", "joined_after", "sign", "letters", "date", "zero")
SAMPLE, TREES, DEPTH, RATE = 1500, 30, 3, 0.3
CONTEXT = 24
PRECISION = 0.97
SEED = 11
_CANDIDATE = f"struct<start:int,rank:int,kind:string,stop:int,match:string,{','.join(f'{f}:double' for f in FEATURES)}>"


def base_spans(text: Column) -> Column:
    digits = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    part = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
    card = lambda s: F.char_length(digits(s)).between(14, 19) & F.call_function("luhn_check", F.substring(digits(s), 1, 19))
    return F.concat(
        guarded(text, F.contains(text, F.lit("@")), EMAIL, "email", 0),
        guarded(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, "ip", 1, lambda s: s["match"].rlike(part)),
        guarded(text, text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), CARD, "card", 2, card),
        guarded(text, text.rlike(r"\+[0-9]"), PHONE, "phone", 3, lambda s: F.char_length(digits(s)).between(10, 15)),
    )


def candidates(text: Column) -> Column:
    """All generated spans with their features, as an array of _CANDIDATE."""
    parts = [guarded(text, text.rlike(guard), pattern, kind, KINDS.index(kind)) for kind, guard, pattern in GENERATORS]
    indexed = [F.transform(p, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"], s["match"], F.lit(float(i)).alias("generator"))) for i, p in enumerate(parts)]  # noqa: B023

    def features(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, begin + 1, s["start"] - begin)
        after = F.substring(text, s["stop"] + 1, F.lit(8))
        digits = F.regexp_replace(s["match"], "[^0-9]", "")
        number = lambda c: c.cast("double")
        values = {
            "digits": F.char_length(digits),
            "length": F.char_length(s["match"]),
            "separators": F.regexp_count(s["match"], F.lit(r"[ ().\-/]")),
            "groups": F.regexp_count(s["match"], F.lit("[0-9]+")),
            "longest": F.array_max(F.transform(F.split(s["match"], "[^0-9]+"), lambda x: F.char_length(x))),
            "plus": s["match"].rlike(r"^[+(]").cast("int"),
            "luhn": F.coalesce(F.call_function("luhn_check", F.substring(digits, 1, 30)), F.lit(False)).cast("int"),
            "contact": before.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|mail|contact|reach|write|numero|telefon|appel)").cast("int"),
            "identity": before.rlike(r"(?i)\b(?:ssn|social|passport|iban|account|card|konto|carte|cuenta|visa|licen[cs]e no|id)\b").cast("int"),
            "joined_before": before.rlike(r"[A-Za-z0-9_/=.#$-]$").cast("int"),
            "joined_after": after.rlike(r"^(?:[A-Za-z0-9_/=]|\.[0-9]|,[0-9])").cast("int"),
            "sign": (F.contains(s["match"], F.lit("@")) | s["match"].rlike(r"(?i)[(\[]at[)\]]")).cast("int"),
            "letters": F.regexp_count(s["match"], F.lit("[A-Za-z]")),
            "zero": s["match"].rlike(r"^[+(]*0").cast("int"),
            "date": s["match"].rlike(r"^(?:19|20)[0-9]{2}[-/.][01][0-9][-/.][0-3][0-9]|^[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}").cast("int"),
        }
        return F.struct(*(s[c] for c in ("start", "rank", "kind", "stop", "match", "generator")), *(number(values[f]).alias(f) for f in FEATURES[1:]))

    return F.transform(F.concat(*indexed), features).cast(f"array<{_CANDIDATE}>")


def sample(docs: DataFrame, most: int = SAMPLE) -> list[tuple[str, int, str, str, str]]:
    """(kind, base, before, match, after) of at most `most` base matches and as many other candidates of docs(doc_id,
    text), drawn by a hash of doc_id and place from about 8 * `most` documents, two of each from a document at most."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // (8 * most)))) == 0
    clear = lambda a, s: (a["start"] < s["stop"]) & (s["start"] < a["stop"])
    bare = lambda x, base: F.transform(x, lambda s: F.struct(s["kind"].alias("kind"), F.lit(base).alias("base"), s["start"].alias("start"), s["stop"].alias("stop")))
    few = lambda x: F.slice(x, 1, 2)
    both = lambda b: F.concat(bare(few(b), 1), bare(few(F.filter(candidates(F.col("text")), lambda c: ~F.exists(b, lambda a: clear(a, c)))), 0))
    rows = docs.where(part & F.col("text").isNotNull()).select("doc_id", "text", F.explode(let(base_spans(F.col("text")), both)).alias("s"))
    begin = F.greatest(F.col("s.start") - CONTEXT, F.lit(0))
    cut = lambda at, stop: F.substring("text", at + 1, stop - at)
    rows = rows.select("s.kind", "s.base", cut(begin, F.col("s.start")).alias("before"), cut(F.col("s.start"), F.col("s.stop")).alias("match"), cut(F.col("s.stop"), F.col("s.stop") + CONTEXT).alias("after"), F.xxhash64("doc_id", "s.start", "s.kind").alias("place"))
    order = Window.partitionBy("base").orderBy("place", "match", "before")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).orderBy("base", "n")
    return [(r["kind"], r["base"], r["before"], r["match"], r["after"]) for r in rows.collect()]


def invented(found: list[tuple[str, int, str, str, str]], n: int = 2 * SAMPLE, seed: int = SEED) -> list[tuple[int, str, int, int, int]]:
    """(id, text, start, stop, personal), one span each: the sample's, written in other ways, and n invented ones in
    contexts of the sample, or of syllables where it is empty."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("ka", "to", "mi", "re", "sun", "dol", "ar", "pe")) for _ in range(rng.randint(1, 3)))
    contexts = [(before, after) for _, _, before, _, after in found if not before or before[-1] in " \n\t:"]
    out: list[tuple[int, str, int, int, int]] = []

    def add(before: str, span: str, after: str, personal: int) -> None:
        out.append((len(out), before + span + after, len(before), len(before) + len(span), personal))

    def phone(number: str) -> str:
        a, b, c = number[:3], number[3:6], number[6:10]
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a[0]} " + " ".join(number[i : i + 2] for i in range(1, 9, 2))))

    def address(name: str, host: str) -> str:
        at, dot = rng.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "(dot)"), (" @ ", " dot ")))
        return name + at + host.replace(".", dot)

    def wrong_card(number: str) -> str:
        n = number[:-1] + str((int(number[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice((n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4))))

    for kind, base, before, match, after in found:
        number = "".join(c for c in match if c in "0123456789")
        if not base:
            if kind in ("number_like", "card_like"):  # the other kinds may be personal, so they teach nothing
                add(before, match, after, 0)
        elif kind == "email":
            add(before, address(*match.rsplit("@", 1)), after, 1)
        elif kind == "phone" and len(number) >= 10:
            add(before, phone(number[-10:]), after, 1)
        elif kind == "card" and len(number) == 16:
            add(before, wrong_card(number), after, 0)
    for _ in range(n):
        before, after = rng.choice(contexts) if contexts else (" ".join(word() for _ in range(4)) + " ", f" {word()} {word()}")
        year = rng.randint(1950, 2030)
        if rng.random() < 0.5:
            if rng.random() < 0.25:
                before += rng.choice(("tel ", "phone: ", "call ", "contact ", "iban ", "ssn ", "account "))
            account = rng.choice("ABCDEFGH") + rng.choice("ESRLT") + digits(2) + rng.choice(("", " ")).join(["", *(digits(4) for _ in range(4))])
            span = rng.choice((lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: account, lambda: phone(str(rng.randint(2, 9)) + digits(9)), lambda: address(word(), f"{word()}.{rng.choice(('com', 'org', 'net'))}")))()
            add(before, span, after, 1)
            continue
        if rng.random() < 0.25:
            before += rng.choice(("order ", "part ", "total ", "page ", "code ", "version ", "no. "))
        span = rng.choice(
            (
                f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(10, 23)}.{rng.randint(10, 59)}",
                " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(7, 12))),
                f"{rng.randint(1, 9)}.{digits(rng.randint(9, 15))}",
                "/".join(digits(3) for _ in range(4)),
                digits(rng.choice((9, 11, 12, 13, 20, 22, 24))),
                f"{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
                f"{word()} at {word()} dot {word()}",
                f"{year}-{year + 3} {year + 4}-{year + 9}",
                wrong_card("4" + digits(15)),
                phone(str(rng.randint(2, 9)) + digits(9)) + rng.choice(("/", "_", "x", ".")) + digits(3),
            )
        )
        add(before + rng.choice(("", "", "", "#", "=", "/")), span, rng.choice(("", "", "", "/", "_")) + after, 0)
    rng.shuffle(out)
    return [(i, *row[1:]) for i, row in enumerate(out)]


class Trees:
    """Gradient boosting for the logistic loss, with calibrated probabilities and a threshold for each kind. Rows leave
    0, 1 or 2 by `part`: they fit, calibrate or measure. figures[kind] is (precision, recall, personal rows)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, part: np.ndarray) -> None:
        fits, tunes, tests = (part % 3 == k for k in range(3))
        self.trees: list = []
        margin = np.zeros(fits.sum())
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x[fits], y[fits] - p, p * (1 - p), DEPTH)
            self.trees.append(tree)
            margin += self._value(tree, x[fits])
        held = sum(self._value(t, x[tunes]) for t in self.trees)
        a, b, target = 1.0, 0.0, y[tunes]
        for _ in range(200):  # Platt's scaling
            g = 1 / (1 + np.exp(-(a * held + b))) - target
            a, b = a - 0.5 * float((g * held).mean()) / (1 + float((held**2).mean())), b - 0.5 * float(g.mean())
        self.scale = (a, b)
        chance = 1 / (1 + np.exp(-(a * held + b)))
        final = 1 / (1 + np.exp(-(a * sum(self._value(t, x[tests]) for t in self.trees) + b)))
        self.thresholds, self.figures = {}, {}
        for kind in range(len(BASE), len(KINDS)):
            mine = kinds[tunes] == kind
            order = np.argsort(-chance[mine], kind="stable")
            hits = np.cumsum(target[mine][order]) / (np.arange(len(order)) + 1)
            good = np.flatnonzero(hits >= PRECISION)
            self.thresholds[kind] = max(0.5, float(chance[mine][order][good[-1]])) if len(good) else 2.0
            of = kinds[tests] == kind
            said, true = final[of] >= self.thresholds[kind], y[tests][of] == 1
            self.figures[KINDS[kind]] = (float((said & true).sum() / max(1, said.sum())), float((said & true).sum() / max(1, true.sum())), int(true.sum()))

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = RATE * float(g.sum() / (h.sum() + 1))
        best, at = 1e-6, None
        if depth and len(g) >= 20:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
                    low = x[:, f] <= cut
                    if low.all() or not low.any():
                        continue
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - base
                    if gain > best:
                        best, at = gain, (f, float(cut))
        if at is None:
            return leaf
        low = x[:, at[0]] <= at[1]
        return (*at, self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def score(self, s: Column) -> Column:
        """The calibrated probability of a candidate, as an expression."""

        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(s[FEATURES[tree[0]]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

        total = sum((case(t) for t in self.trees[1:]), case(self.trees[0]))
        return 1 / (1 + F.exp(-(total * self.scale[0] + self.scale[1])))

    def least(self, s: Column) -> Column:
        out = F.lit(2.0)
        for kind, threshold in self.thresholds.items():
            out = F.when(s["rank"] == kind, F.lit(threshold)).otherwise(out)
        return out


def fit(spark: SparkSession, docs: DataFrame | None = None) -> Trees:
    """Trees for docs(doc_id, text), or for invented sentences only where none are given."""
    found = [] if docs is None else sample(docs)
    rows = spark.createDataFrame(invented(found), "id int, text string, begin int, finish int, personal int")
    span = rows.select("id", "begin", "finish", "personal", F.explode(candidates(F.col("text"))).alias("c"))
    right = (F.abs(F.col("c.start") - F.col("begin")) <= 1) & (F.abs(F.col("c.stop") - F.col("finish")) <= 1) & (F.col("personal") == 1)
    table = np.array(span.orderBy("id", "c.start", "c.generator").select(right.cast("double"), F.col("c.rank").cast("double"), F.col("id").cast("double"), *(F.col(f"c.{f}") for f in FEATURES)).collect(), dtype=float)
    return Trees(table[:, 3:], table[:, 0], table[:, 1].astype(int), table[:, 2].astype(int))


def find(text: Column, trees: Trees) -> Column:
    """struct(base, spans): base spans, and all spans, each sorted by start and then kind as listed."""
    bare = lambda x: F.transform(x, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"]))
    order = lambda x: F.array_sort(F.array_distinct(bare(x)))

    def both(base: Column) -> Column:
        scored = F.transform(candidates(text), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["match"].alias("match"), trees.score(s).alias("score"), trees.least(s).alias("least")))
        chosen = F.filter(scored, lambda s: s["score"] >= s["least"])
        clear: Callable[[Column, Column], Column] = lambda a, s: (a["start"] < s["stop"]) & (s["start"] < a["stop"])
        free = F.filter(chosen, lambda s: ~F.exists(base, lambda a: clear(a, s)))
        first = let(free, lambda c: F.filter(c, lambda s: ~F.exists(c, lambda a: clear(a, s) & ((a["score"] > s["score"]) | ((a["score"] == s["score"]) & ((a["start"] < s["start"]) | ((a["start"] == s["start"]) & (a["rank"] < s["rank"]))))))))
        return F.struct(order(base).alias("base"), order(F.concat(base, F.transform(first, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"], s["match"])).cast(SPANS))).alias("spans"))

    return let(base_spans(text), both)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with a column `pii`: struct(base, spans). Null texts are empty, and empty ones have no span;
    repeated rows stay, with equal spans; whole texts count, however long. Of added spans that overlap, the more probable
    stays, the earlier on ties; base spans stay in any case. An empty table has no row."""
    return docs.withColumn("pii", find(F.coalesce(F.col("text"), F.lit("")), fit(spark, docs)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of documents; null texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(spark, docs).select("doc_id", "pii")
    base = F.col("pii.base")
    counts = [F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii.spans")).alias("spans"))
