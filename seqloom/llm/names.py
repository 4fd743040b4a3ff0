"""Variant spellings of people and organisations, linked by a prefix-filtered set-similarity join on token q-grams.

1. Every distinct spelling is parsed once, into the part that names (a surname, or the words of an organisation) and, for people, a
   given name and initials. Titles, particles and short forms of given names are not listed anywhere: they are learned from how
   words stand in the spellings and which initials go with which given names under one surname.
2. The distinct naming parts are sets of the 3-grams of their words, each gram weighing by its rarity over all of them. Two parts whose weighted
   similarity reaches LEAST_SHARED share a gram (surnames: two) among the rarest of either, namely of those without which the rest would not weigh
   enough; only those prefixes are joined.
3. What the join finds is verified: a surname may differ by one typing error; organisations by a soft similarity of their words, in which each counts by
   its rarity and may match by spelling, as an abbreviation, as letters of an acronym or with one typing error.
4. People of similar surnames are linked if the initials of their formal given names agree and their middle initials don't differ. Connected ones are one entity.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.session import cut_lineage, release

Q = 3
#: Naming parts are compared if so much of their weighted 3-grams is common.
LEAST_SHARED = {"p": 0.25, "o": 0.2}
#: Surnames must have two grams in common: pairs of grams are so much rarer that the join's size grows with the names, not with their square.
TOGETHER = {"p": 2, "o": 1}
#: How steeply a gram's weight rises with its rarity. Organisations share most of their words with others.
STEEPNESS = {"p": 1, "o": 4}
#: Grams in fewer naming parts than this all weigh the same: a typing error makes grams that are rare for no good reason.
RAREST = 8
#: Words of one typing error must be at least this long.
SHORTEST = 5
SCORE, TYPO_SCORE, MOST_WEIGHT = 0.85, 0.9, 6.0
#: A role is learned for a word that plays it in this share of all spellings, and so many.
ROLE_SHARE, ROLE_LEAST = 0.0002, 3
#: Mentions of a pair of blocks that one task joins.
PAIR_BLOCK = 4096


def fold(text: str) -> str:
    """Without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def plain_vowels(word: str) -> str:
    """'ae', 'oe' and 'ue' are the other spelling of marked vowels and lose their mark too."""
    return re.sub("([aou])e", r"\1", word)


class Roles:
    """What the spellings taught about words: titles after a name, particles before a surname, short given names."""

    def __init__(self, titles: frozenset[str] = frozenset(), particles: frozenset[str] = frozenset(), short: frozenset[str] = frozenset()):
        self.titles, self.particles, self.short = titles, particles, short


def _bare(word: str) -> str:
    return re.sub("[^A-Za-z]", "", word)


def _is_initials(word: str, loud: bool, roles: Roles) -> bool:
    """Letters that stand for given names: 'F.', 'FM', 'F.M.'. Where all is in capitals, a known short given name is none."""
    bare = _bare(word)
    return len(bare) == 1 or "." in word and len(bare) <= 3 or bare.isupper() and len(bare) <= 3 and not (loud and bare.lower() in roles.short)


def _split_person(raw: str, roles: Roles) -> tuple[list[str], list[str], bool]:
    """Words of the surname, words of the given names, and whether all is in capitals."""
    s = fold(raw)
    loud = s.isupper()
    words = lambda t: [w for w in re.findall(r"[A-Za-z'\-.]+", t) if _bare(w)]
    untitled = lambda ws: [w for i, w in enumerate(ws) if not (i and _bare(w).lower() in roles.titles)]
    if "," in s:
        last, first = s.split(",", 1)
        return words(last), untitled(words(first)), loud
    ws = untitled(words(s))
    if len(ws) > 1 and _is_initials(ws[-1], loud, roles):
        return ws[:-1], ws[-1:], loud
    at = len(ws) - 1
    while at > 1 and (ws[at - 1][0].islower() or ws[at - 1].lower() in roles.particles):
        at -= 1
    return ws[max(at, 0) :], ws[: max(at, 0)], loud


def role_counts(raw: str) -> Iterator[tuple[str, str]]:
    """(role, word) that one spelling of a person is a sign for."""
    last, first, loud = _split_person(raw, Roles())
    if loud:
        return
    for w in last[:-1]:
        if w[0].islower():
            yield "particle", w.lower()
    for i, w in enumerate(first):
        if len(_bare(w)) > 1 and any(c.islower() for c in w):
            yield ("later" if i else "given"), _bare(w).lower()


def parse_person(raw: str, roles: Roles = Roles()) -> tuple[list[str], str, str, str] | None:
    """Surname words, the given name if it is written out, first and middle initial; None if no surname is left."""
    last, first, loud = _split_person(raw, roles)
    named = [w for w in last if not (w[0].islower() and not loud and len(last) > 1) and w.lower() not in roles.particles] or last
    surname = sorted(_bare(w).lower() for w in named)
    if not surname:
        return None
    given: list[str] = []
    full = ""
    for w in first:
        if w.lower() in roles.particles or (w[0].islower() and not loud):
            continue
        bare = _bare(w).lower()
        if _is_initials(w, loud, roles):
            given += list(bare)
        else:
            full = full or ("" if given else bare)
            given.append(bare[0])
    return surname, full, given[0] if given else "", given[1] if len(given) > 1 else ""


def parse_organisation(raw: str) -> list[str]:
    """The words, sorted; a hyphen separates, an apostrophe doesn't."""
    return sorted({plain_vowels(w) for w in re.findall("[a-z]+", fold(raw).lower().replace("'", "").replace("’", ""))})


def one_error(a: str, b: str) -> bool:
    """Whether two words differ by one letter inserted, left out, replaced or swapped with the next."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def soft_match(a: dict[str, float], b: dict[str, float]) -> tuple[float, list[str], list[str]]:
    """Similarity of two weighted word sets, and the words of each that found no partner.

    The similarity is the matched weight as a share of what is matched and the lighter rest; it is 0 if the heaviest word of either, which
    tells most about who is meant, is among the rest.
    """
    left, right = dict(a), dict(b)
    top = [max(x, key=lambda w: (x[w], w)) for x in (a, b) if x]
    matched = 0.0

    def take(x: str, y: str, sim: float) -> None:
        nonlocal matched
        matched += sim * max(left.pop(x), right.pop(y))

    for x in list(left):
        if x in right:
            take(x, x, 1.0)
    for x in list(left):  # abbreviations: all of a word's beginning
        y = next((y for y in right if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))), None)
        if y is not None:
            take(x, y, 1.0)
    for x in list(left):
        y = next((y for y in right if min(len(x), len(y)) >= SHORTEST and one_error(x, y)), None)
        if y is not None:
            take(x, y, TYPO_SCORE)
    for one, other in ((left, right), (right, left)):  # acronyms: a letter for each of several words of the other, but not for its heaviest
        for x in [w for w in one if len(w) <= 4]:
            used: list[str] = []
            for i, c in enumerate(x):
                if used and x[i:] in other:  # the rest stands there as an acronym itself
                    used.append(x[i:])
                    break
                y = next((p for p in sorted(other) if p[0] == c and len(p) >= 3 and p not in used and p not in top), None)
                if y is None:
                    used.clear()
                    break
                used.append(y)
            if len(used) > 1:
                one.pop(x)
                matched += sum(other.pop(y) for y in used)
    if any(t in left or t in right for t in top) or not matched:
        return 0.0, list(left), list(right)
    return matched / (matched + min(sum(left.values()), sum(right.values()))), list(left), list(right)


def soft_similarity(a: dict[str, float], b: dict[str, float]) -> float:
    return soft_match(a, b)[0]


def grams(name: str) -> list[str]:
    """The distinct 3-grams of a name's words with plain vowels, each padded at its front only, so that an abbreviation shares all of its own."""
    return sorted({padded[i : i + Q] for w in name.split() for padded in ["#" * (Q - 1) + plain_vowels(w)] for i in range(len(padded) - Q + 1)})


class Rarity:
    """Weights of grams and words by the number of naming parts of their kind that have them."""

    def __init__(self, n: dict[str, int], df: dict[tuple[str, str], int]):
        self.n, self.df = n, df

    def gram(self, kind: str, g: str) -> float:
        return math.log(1 + self.n.get(kind, 1) / max(RAREST, self.df.get((kind, g), 0))) ** STEEPNESS[kind]

    def words(self, kind: str, name: str, optional: dict[str, float] | None = None) -> dict[str, float]:
        """Each word weighs by its rarest gram, as no word is in more names than that, and the less the more optional it is."""
        rarest = lambda w: min(self.df.get((kind, g), 1) for g in grams(w))
        return {w: min(MOST_WEIGHT, max(1.0, math.log(self.n.get(kind, 1) / rarest(w)))) * (1 - (optional or {}).get(w, 0.0)) for w in name.split()}

    def prefix(self, kind: str, name: str) -> tuple[list[str], float]:
        """Keys of a name's rarest grams, and the weight of all its grams. Every name that is similar enough shares a key.

        What is left out weighs so little that names which share only that are not similar enough; where two grams must be shared, not even together
        with the heaviest one.
        """
        ranked = sorted(((self.gram(kind, g), self.df.get((kind, g), 0), g) for g in grams(name)), key=lambda x: (-x[0], x[1], x[2]))
        whole = rest = sum(w for w, _, _ in ranked)
        enough = LEAST_SHARED[kind] * whole - (ranked[0][0] if ranked and TOGETHER[kind] > 1 else 0.0)
        out = []
        for w, _, g in ranked:
            if rest < enough:
                break
            out.append(g)
            rest -= w
        if TOGETHER[kind] > 1 and len(out) > 1:
            out = [f"{a} {b}" for a, b in combinations(sorted(out), 2)]
        return out, whole


def _rarity(mains: DataFrame) -> Rarity:
    """Counts of all grams. The driver is told at most 27 ** 3 of them a kind, whatever the number of names: their letters are a to z and the pad."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((k, g) for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in grams(name))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([g for _, g in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "gram", "n"])

    df = mains.select("kind", "main").mapInArrow(kernel, "kind string, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect()
    n = {r.kind: r["count"] for r in mains.groupBy("kind").count().collect()}
    return Rarity(n, {(r.kind, r.gram): r.n for r in df})


def _one_error(x: Column, y: Column) -> Column:
    """As one_error(), within compiled code."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))) == y)
    far = F.levenshtein(x, y, 2)
    return (far == 1) | ((far == 2) & (F.length(x) == F.length(y)) & (F.length(x) > 1) & swapped)


def similar_names(mains: DataFrame) -> DataFrame:
    """Pairs ``kind``, ``x`` < ``y`` of the distinct naming parts (``kind``, ``main``) that may be spellings of one, verified."""
    rarity = _rarity(mains)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, names, plain, out, weights = [], [], [], [], []
            for kind, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                some, whole = rarity.prefix(kind, name)
                kinds += [kind] * len(some)
                names += [name] * len(some)
                plain += [plain_vowels(name)] * len(some)
                out += some
                weights += [whole] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(out, pa.string()), pa.array(names, pa.string()), pa.array(plain, pa.string()), pa.array(weights, pa.float64())], names=["kind", "gram", "main", "plain", "w"])

    spark = mains.sparkSession
    # Few bytes make many pairs: as many tasks as there are partitions, not as few as the bytes would ask for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    prefix = mains.select("kind", "main").mapInArrow(kernel, "kind string, gram string, main string, plain string, w double").repartition(tasks, "kind", "gram")
    x, y = (prefix.select("kind", "gram", F.col("main").alias(c), F.col("plain").alias(f"p{c}"), F.col("w").alias(f"w{c}")) for c in "xy")
    least = F.when(F.col("kind") == "p", LEAST_SHARED["p"]).otherwise(LEAST_SHARED["o"])
    met = x.join(y, ["kind", "gram"]).where((F.col("x") < F.col("y")) & (F.least("wx", "wy") >= least * F.greatest("wx", "wy")))
    # A surname's verdict costs no more than telling its pairs apart, so it comes first.
    px, py = F.col("px"), F.col("py")
    long = (F.length("x") >= SHORTEST) & (F.length("y") >= SHORTEST) & (F.abs(F.length(px) - F.length(py)) <= 2)
    people = met.where((F.col("kind") == "p") & ((px == py) | (long & (_one_error(px, py) | (((px != F.col("x")) | (py != F.col("y"))) & _one_error(F.col("x"), F.col("y")))))))
    return people.select("kind", "x", "y").distinct().unionByName(_similar_bodies(met.where("kind = 'o'").select("x", "y").distinct(), rarity))


def _similar_bodies(met: DataFrame, rarity: Rarity) -> DataFrame:
    """Verified pairs of organisations.

    Words such as articles are there in one spelling and left out in another. How optional a word is is learned from the pairs that are
    similar enough at first: the share of them in which it finds no partner. Then all are compared again, without its optional part.
    """
    met = cut_lineage(met)

    @F.pandas_udf("array<struct<word:string,alone:boolean>>")
    def partners(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b):
            x, y = rarity.words("o", p), rarity.words("o", q)
            score, left, right = soft_match(x, y)
            out.append([{"word": w, "alone": w in own} for ws, own in ((x, left), (y, right)) for w in ws] if score >= SCORE else [])
        return pd.Series(out, dtype=object)

    seen = met.select(F.explode(partners("x", "y")).alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("alone"))
    pairs = met.count()
    # Few words are in that share of all pairs.
    told = seen.where((F.col("n") >= max(ROLE_LEAST, ROLE_SHARE * pairs)) & (F.col("alone") > 0)).collect()
    optional = {r.word: r.alone / r.n for r in told}

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([soft_similarity(rarity.words("o", p, optional), rarity.words("o", q, optional)) for p, q in zip(a, b)], dtype=float)

    return met.where(score("x", "y") >= SCORE).select(F.lit("o").alias("kind"), "x", "y")


def given_initials(spelled: DataFrame) -> DataFrame:
    """``full``, ``formal``: written-out given names that go with the initial of another one, such as a short form with that of its formal name.

    Learned from the surnames under which a name occurs written out and someone with initials only: the formal initial is the one met under most
    of them, if that is more often than the name's own by far.
    """
    people = spelled.where("kind = 'p' and g != ''")
    written = people.where("full != ''").select("main", "full").distinct()
    initials = people.where("full = ''").select("main", F.col("g").alias("formal")).distinct()  # at most 26 for a surname
    met = written.join(initials, "main").groupBy("full", "formal").agg(F.count(F.lit(1)).alias("n"))
    own = F.sum(F.when(F.col("formal") == F.substring("full", 1, 1), F.col("n")).otherwise(0))
    best = met.groupBy("full").agg(F.max_by("formal", F.struct("n", "formal")).alias("formal"), F.max("n").alias("most"), own.alias("own"), F.sum("n").alias("all"))
    return best.where(f"formal != left(full, 1) and most >= {ROLE_LEAST} and most > 2 * own and 2 * most >= all").select("full", "formal")


def mentions(df: DataFrame, ref: str = "ref_id", authors: str = "authors", consortium: str = "consortium") -> DataFrame:
    """``ref_id``, ``author_no``, ``kind`` ('p' or 'o'), ``raw``: the names in both columns. Null and blank names are no mentions."""
    base = df.select(F.col(f"`{ref}`").alias("ref_id"), F.col(f"`{authors}`").alias("a"), F.col(f"`{consortium}`").alias("c"))
    people = base.select("ref_id", F.posexplode(F.split("a", ", | and ")).alias("i", "raw")).select("ref_id", (F.col("i") + 1).cast("long").alias("author_no"), F.lit("p").alias("kind"), "raw")
    bodies = base.select("ref_id", F.lit(0).cast("long").alias("author_no"), F.lit("o").alias("kind"), F.col("c").alias("raw"))
    return people.unionByName(bodies).where(F.trim("raw") != "")


def _roles(raw: DataFrame) -> Roles:
    """Titles, particles and short given names, from counts over all distinct spellings of people."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(x for t in b.column(0).to_pylist() for x in role_counts(t))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["role", "word", "n"])

    people = raw.where("kind = 'p'").select("raw")
    least = max(ROLE_LEAST, ROLE_SHARE * people.count())
    # Few words play a role in that share of all spellings.
    counted = people.mapInArrow(kernel, "role string, word string, n long").groupBy("role", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    by = {(r.role, r.word): r.n for r in counted}
    titles = frozenset(w for (r, w), n in by.items() if r == "later" and by.get(("given", w), 0) * 10 <= n)
    return Roles(titles, frozenset(w for r, w in by if r == "particle"), frozenset(w for r, w in by if r == "given" and len(w) <= 3))


def resolve(named: DataFrame) -> DataFrame:
    """``kind``, ``raw``, ``entity`` for every distinct spelling in a table of mentions (``kind``, ``raw``).

    A spelling that holds no name is an entity of its own. People without any given name are apart from those with one. Under a
    surname and first initial with several middle initials, those who give none are an entity apart: nobody can tell whose
    they are. Spellings, naming parts and pairs of them are each joined as distinct values, so neither a spelling nor an entity
    that makes up a third of all mentions gathers in one task. An empty table gives no rows. Names of any length are parsed whole.
    """
    raw = cut_lineage(named.select("kind", "raw").distinct())
    roles = _roles(raw)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = parse_person(text, roles) if kind == "p" else (parse_organisation(text), "", "", "")
                words, full, g, m = got or ([], "", "", "")
                rows.append((kind, text, " ".join(words) or "=" + text, full, g, m))
            names = ["kind", "raw", "main", "full", "g", "m"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], names=names)

    first = cut_lineage(raw.mapInArrow(parsed, "kind string, raw string, main string, full string, g string, m string"))
    formal = given_initials(first)
    spelled = first.join(formal, "full", "left").withColumn("g", F.coalesce("formal", "g"))
    under = Window.partitionBy("kind", "main", "g")  # the spellings of one name, few after the first
    told = F.nullif("m", F.lit(""))
    middle = F.when(F.min(told).over(under) == F.max(told).over(under), F.min(told).over(under)).otherwise(F.col("m"))
    spelled = spelled.withColumn("m", F.coalesce(middle, F.lit("")))
    spelled = cut_lineage(spelled.select("kind", "raw", "main", "g", "m", F.concat_ws("\x01", "kind", "main", "g", "m").alias("unit")))
    release(raw, first)

    close = similar_names(spelled.where("left(main, 1) != '='").select("kind", "main").distinct())
    units = spelled.select("kind", "main", "g", "m", "unit").distinct()
    x, y = (units.select("kind", F.col("main").alias(c), "g", F.col("m").alias(f"m{c}"), F.col("unit").alias(f"unit_{c}")) for c in "xy")
    edges = close.join(x, ["kind", "x"]).join(y, ["kind", "y", "g"]).where("mx = my or mx = '' or my = ''").select("unit_x", "unit_y")
    roots = components(edges, "unit_x", "unit_y")
    return spelled.join(roots, spelled["unit"] == roots["node"], "left").select("kind", "raw", F.coalesce("component", "unit").alias("entity"))


def link_mentions(df: DataFrame, ref: str = "ref_id", authors: str = "authors", consortium: str = "consortium") -> DataFrame:
    """Every mention with its entity: ``ref_id``, ``author_no``, ``kind``, ``raw``, ``entity``. Only the three named columns are read.

    Rows of a null reference are kept. See resolve() for the rest.
    """
    found = mentions(df, ref, authors, consortium)
    return found.join(resolve(found), ["kind", "raw"])


def mention_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of mentions of one entity in two different references, the smaller (ref_id, author_no) first.

    The mentions of a frequent entity are cut into blocks by hash, and each pair of blocks is joined by itself.
    """
    rows = linked.where("ref_id is not null").select("entity", "ref_id", "author_no")
    many = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(many, "entity").withColumn("own", F.pmod(F.xxhash64("ref_id", "author_no"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda s, i, j: rows.select("entity", F.col("own").alias(i), F.col("other").alias(j), F.col("ref_id").alias(f"ref_id_{s}"), F.col("author_no").alias(f"author_no_{s}"))
    met = side("a", "i", "j").join(side("b", "j", "i"), ["entity", "i", "j"])
    return met.where("ref_id_a < ref_id_b").select("ref_id_a", "author_no_a", "ref_id_b", "author_no_b")
