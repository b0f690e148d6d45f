"""Variant spellings of names typed by people: link the spellings of one person, group or unit.

1. Each name is read into a core (surname, place), a gate that all spellings of the entity share
   (initial; codes of unit and kind of body) and what only narrows it (given and middle names). Of
   "A, B" the reading counts whose given name more names of the corpus begin with.
2. Equal readings are one form. Forms are blocked by MinHash banding over the padded q-grams of the
   core, within a gate; the number of bands follows from the collision curve at the likeness that one
   typo leaves in a core of that length. Cores of few letters are blocked exactly, by what is left without one letter.
3. Candidate forms are verified: at most one edit between the cores, and Monge-Elkan likeness of the
   words of both names, of which one edit is always allowed. Folded texts are compared with folded words, texts as
   written with words as written.
4. Star clustering: the form with most names is a centre and takes its verified neighbours; what is
   left goes on, until nothing is.
5. Where one cluster still holds several full given or middle names, these part it. Given names one edit
   apart are first clustered in the same way, so a misspelt one parts nothing.

Blocks hold distinct forms, never names, so a spelling that a third of all rows carry is one form.
Nothing is collected and no block is cut; joins on band keys are ordinary shuffle joins that AQE may split.

Defined results: null and blank names are linked to nothing; repeated rows of one text are spellings
of the same entity; names without a core form a cluster only with equal readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.llm import nameparse, similarity
from strandlog.session import materialize

#: banding: rows a band, the recall asked of a name with its worst typo, and the letters up to which names are blocked exactly
ROWS, RECALL, CORE_LENGTH = 3, 0.9999, 8
#: names of a part of a large entity when its pairs are joined
PAIRS_OF = 2000
#: rounds of star clustering in which weight decides; in what is left a hash does, which ends long chains soon
RANKED_ROUNDS = 12
#: letters of the shortest core in which an edit is taken for a typo
LEAST_LENGTH = 3
#: least Monge-Elkan likeness of two names of one entity; short words may have less, as one edit is more of them
LEAST_LIKENESS = 0.85

_READING = T.StructType([*(T.StructField(c, T.StringType()) for c in ("cls", "core", "raw", "gate", "given", "middle")), T.StructField("tokens", T.ArrayType(T.StringType()))])
_PARSED = T.StructType([T.StructField("first", _READING), T.StructField("turned", _READING)])
_FORM = ["kind", "cls", "core", "gate"]


def _reading(r: dict | None) -> dict | None:
    return None if r is None else {"cls": r["cls"], "core": r["core"], "raw": r["raw"], "gate": r["gate"], "given": r.get("given"), "middle": r.get("middle"), "tokens": r["tokens"]}


@F.pandas_udf(_PARSED)
def _parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for kinds, names in batches:
        first, turned = [], []
        for kind, name in zip(kinds, names, strict=True):
            one, other = None, None
            if name is not None and kind is not None:
                one, other = nameparse.parse_person(name) if kind == "author" else (nameparse.parse_organisation(name), None)
            first.append(_reading(one))
            turned.append(_reading(other))
        yield pd.DataFrame({"first": pd.Series(first, dtype=object), "turned": pd.Series(turned, dtype=object)})


def read_names(names: DataFrame) -> DataFrame:
    """name_id, kind, cls, core, raw, gate, given, middle, tokens: the reading of each name; unreadable names are left out."""
    parsed = materialize(names.select("name_id", "kind", "name", _parse("kind", "name").alias("p")))  # read three times
    plain = F.col("p.turned").isNull() & F.col("p.first.given").isNotNull() & ~F.contains(F.col("name"), F.lit(","))
    begins = parsed.filter(plain).groupBy(F.col("p.first.given").alias("given")).agg(F.count(F.lit(1)).alias("n"))
    # most names have no full given name: their keys are spread, as equal ones would fill one partition of the join
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("name_id", "name"), F.lit(4096)).cast("string"))
    with_counts = (
        parsed.withColumn("g1", F.coalesce("p.first.given", spread)).withColumn("g2", F.coalesce("p.turned.given", spread))
        .join(begins.select(F.col("given").alias("g1"), F.col("n").alias("n1")), "g1", "left")
        .join(begins.select(F.col("given").alias("g2"), F.col("n").alias("n2")), "g2", "left")
    )
    turn = F.col("p.turned").isNotNull() & (F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0)))
    return with_counts.select("name_id", "kind", F.when(turn, F.col("p.turned")).otherwise(F.col("p.first")).alias("r")).filter("r is not null").select("name_id", "kind", "r.*")


def bands_at(length: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands for a core of a length; a longer one needs fewer, and shares those it has with all shorter ones."""
    return similarity.bands_for(recall, similarity.typo_jaccard(length), rows)


def band_keys(rows: int = ROWS, recall: float = RECALL, length: int = CORE_LENGTH):
    """UDF (core, salt) -> array<bigint>: one key per band, as many bands as the collision curve asks for at the core's length."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hasher = similarity.MinHash(rows, bands_at(length, rows, recall))
        known: dict[int, int] = {}
        for cores, salts in batches:
            out = []
            for c, s in zip(cores, salts, strict=True):
                if len(c) not in known:
                    known[len(c)] = bands_at(max(len(c), length), rows, recall)
                out.append(hasher.keys(c, s, known[len(c)]))
            yield pd.Series(out, dtype=object)

    return keys


def deletion_keys(text: Column, salt: Column) -> Column:
    """array<bigint>: a key of the text and of each text with one letter less; texts one edit or swap apart share one."""
    less = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.transform(F.concat(F.array(text), less), lambda t: F.xxhash64(salt, t)))


@F.pandas_udf(T.BooleanType())
def _alike(core_a: pd.Series, core_b: pd.Series, tokens_a: pd.Series, tokens_b: pd.Series, parts: pd.Series) -> pd.Series:
    """At most one edit between the texts, and Monge-Elkan over texts and words. Words count where both names have some.

    Where ``parts`` is set the words are the parts of the text itself, parted by spaces. The least likeness is what one
    edit in the text leaves, if that is lower; where the words are parts of the text, the edit is in the shortest of them too.
    """
    out = []
    for a, b, ta, tb, part in zip(core_a, core_b, tokens_a, tokens_b, parts, strict=True):
        wa, wb = ([] if t is None else list(t) for t in (ta, tb))
        if part:
            wa, wb, a, b = a.split(" "), b.split(" "), a.replace(" ", ""), b.replace(" ", "")
        if not similarity.within_one_edit(a, b):
            out.append(False)
            continue
        known = bool(wa) and bool(wb)
        one, other = [a, *(wa if known else [])], [b, *(wb if known else [])]
        edit = 1 / min(len(a), len(b)) + (1 / min(map(len, wa + wb)) if known and part else 0)
        least = min(LEAST_LIKENESS, 1 - edit / min(len(one), len(other)))
        out.append(similarity.monge_elkan(one, other) >= least - 1e-9)
    return pd.Series(out, dtype=bool)


def link_forms(forms: DataFrame) -> DataFrame:
    """(a, b) form ids, a < b, of verified pairs. forms: id, kind, cls, core, gate, tokens, raws.

    A core is blocked as folded and as written with ae, oe, ue, since a typo can make or break these pairs.
    A double surname is blocked whole and by its halves, as one half is often left out; two forms link by
    a half of one and the whole of the other, never by halves of both. The words of a person's text are parted by
    spaces, which do not count in its keys; the words of other texts are those known of both names.
    """
    salt = F.concat_ws("\x01", "kind", "cls", "gate")
    person = F.col("cls") == "person"
    nothing = F.array().cast("array<string>")
    wholes = F.array_union(F.array(F.when(person, F.array_join("tokens", " ")).otherwise(F.col("core"))), F.coalesce("raws", nothing))
    halves = F.array_distinct(F.flatten(F.transform(wholes, lambda w: F.when(F.size(F.split(w, " ")) == 2, F.filter(F.split(w, " "), lambda t: F.length(t) >= 5)).otherwise(nothing))))
    halves = F.when(person, F.array_except(halves, wholes)).otherwise(nothing)
    texts = F.concat(F.transform(wholes, lambda t: F.struct(t.alias("words"), F.lit(True).alias("whole"))), F.transform(halves, lambda t: F.struct(t.alias("words"), F.lit(False).alias("whole"))))
    each = forms.filter(F.length("core") >= LEAST_LENGTH).select("id", person.alias("person"), salt.alias("salt"), F.inline(texts))
    each = each.withColumn("text", F.when(F.col("person"), F.replace(F.col("words"), F.lit(" "), F.lit(""))).otherwise(F.col("words")))
    # texts of just the length are keyed both ways, so those one letter longer or shorter meet them
    long, short = each.filter(F.length("text") >= CORE_LENGTH), each.filter(F.length("text") <= CORE_LENGTH)
    keyed = long.select("id", "words", "text", "whole", F.explode(band_keys()("text", "salt")).alias("band")).unionByName(
        short.select("id", "words", "text", "whole", F.explode(deletion_keys(F.col("text"), F.col("salt"))).alias("band"))
    ).select("band", "id", "words", F.when(F.col("text") != F.col("words"), F.col("text")).alias("text"), "whole")
    side = lambda s: keyed.select("band", F.col("id").alias(s), F.col("words").alias(f"words_{s}"), F.coalesce("text", "words").alias(f"text_{s}"), F.col("whole").alias(f"whole_{s}"))
    near = (F.col("a") < F.col("b")) & (F.col("whole_a") | F.col("whole_b")) & (F.abs(F.length("text_a") - F.length("text_b")) <= 1) & (F.levenshtein("text_a", "text_b", 2) >= 0)
    # the planner sizes the exploded keys by the small table they come from and would broadcast them
    candidates = side("a").join(side("b").hint("merge"), "band").filter(near).select("a", "b", "words_a", "words_b", (F.col("whole_a") & F.col("whole_b")).alias("whole")).distinct()
    form = lambda s: forms.select(F.col("id").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.struct("kind", "cls", "gate").alias(f"gate_{s}"))
    full = candidates.join(form("a"), "a").join(form("b"), "b").filter("gate_a = gate_b")
    of_person = F.col("gate_a.cls") == "person"
    text = [F.when(of_person & ~F.col("whole"), F.replace(F.col(f"words_{s}"), F.lit(" "), F.lit(""))).otherwise(F.col(f"words_{s}")) for s in "ab"]
    words = [F.when(~of_person & F.col("whole"), F.col(f"tokens_{s}")) for s in "ab"]
    return full.filter(_alike(*text, *words, of_person & F.col("whole"))).select("a", "b").distinct()


def star_clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centre) for every vertex with an edge. vertices: id, weight; edges: a, b.

    A vertex ranks by its weight and its number of neighbours (then by the latter alone, then by the lower id):
    typos of one name surround it. It is a centre when no neighbour that is still unassigned ranks higher; it
    takes its unassigned neighbours, each going to its highest centre. Typos need two or three rounds. A long chain of
    falling ranks would need as many as it is long: after ``RANKED_ROUNDS`` a vertex ranks by the hash of its id, and
    the rounds left are few, as their number then grows with the logarithm of what is left.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "id")
    w = vertices.join(degree, "id").select("id", F.struct((F.col("weight") + F.col("degree")).alias("mass"), "degree").alias("weight"))
    rank = lambda s: F.struct(F.col(f"w_{s}"), -F.col(s))
    rest = materialize(both.join(w.select(F.col("id").alias("a"), F.col("weight").alias("w_a")), "a").join(w.select(F.col("id").alias("b"), F.col("weight").alias("w_b")), "b"))
    done, rounds = None, 0
    while rest.limit(1).count():
        rounds += 1
        if rounds == RANKED_ROUNDS + 1:
            hashed = lambda s: F.struct(F.xxhash64(F.lit("rank"), s).alias("mass"), F.lit(0).cast("bigint").alias("degree")).alias(f"w_{s}")
            rest = rest.select("a", "b", hashed("a"), hashed("b"))
        best = rest.groupBy("a", "w_a").agg(F.max(rank("b")).alias("top"))
        centres = best.filter(rank("a") > F.col("top")).select(F.col("a").alias("centre"))
        taken = rest.join(centres.withColumnRenamed("centre", "b"), "b", "left_semi").groupBy("a").agg(F.max_by("b", rank("b")).alias("centre")).select(F.col("a").alias("id"), "centre")
        step = materialize(centres.select(F.col("centre").alias("id"), "centre").unionByName(taken))
        done = step if done is None else done.unionByName(step)
        gone = step.select("id")
        left = rest.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        alone = rest.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").select(F.col("a").alias("id")).distinct().join(left.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        left = materialize(left)
        done = done.unionByName(alone.select("id", F.col("id").alias("centre")))
        rest = left
    if done is None:
        done = vertices.select("id", F.col("id").alias("centre")).limit(0)
    return done


def given_spellings(placed: DataFrame) -> DataFrame:
    """centre, given, main: the spelling that stands for a full given name within a cluster, for those that are one edit from another.

    placed: centre, given and other columns, a row per name. One edit is a typo in names of LEAST_LENGTH letters or
    more, but never between two that the list of nicknames has as names of their own.
    """
    listed = F.array(*map(F.lit, sorted(nameparse.GIVEN_NAMES)))
    counted = placed.filter("given is not null").groupBy("centre", "given").agg(F.count(F.lit(1)).alias("weight"))
    several = counted.join(counted.groupBy("centre").count().filter("count > 1").select("centre"), "centre", "left_semi")
    vertices = materialize(several.withColumn("id", F.xxhash64("centre", "given")).withColumn("listed", F.array_contains(listed, F.col("given"))))
    keyed = vertices.filter(F.length("given") >= LEAST_LENGTH).select("id", "centre", "given", "listed", F.explode(deletion_keys(F.col("given"), F.col("centre").cast("string"))).alias("key"))
    side = lambda s: keyed.select("centre", "key", F.col("id").alias(s), F.col("given").alias(f"given_{s}"), F.col("listed").alias(f"listed_{s}"))
    met = side("a").join(side("b").hint("merge"), ["centre", "key"]).filter((F.col("a") < F.col("b")) & ~(F.col("listed_a") & F.col("listed_b"))).select("a", "b", "given_a", "given_b").distinct()
    none = F.lit(None).cast("array<string>")
    edges = materialize(met.filter(_alike("given_a", "given_b", none, none, F.lit(False))).select("a", "b"))
    stars = star_clusters(vertices.select("id", "weight"), edges)
    mains = vertices.select(F.col("id").alias("star"), F.col("given").alias("main"))
    return vertices.select("centre", "given", "id").join(stars.withColumnRenamed("centre", "star"), "id").join(mains, "star").select("centre", "given", "main")


def entities(names: DataFrame) -> DataFrame:
    """name_id, kind, entity: the entity of every readable name. names: name_id, kind, name; other columns are ignored."""
    read = materialize(read_names(names.select("name_id", "kind", "name")))
    with_id = read.withColumn("form", F.xxhash64(*(F.coalesce(c, F.lit("")) for c in _FORM)))
    forms = materialize(with_id.groupBy(F.col("form").alias("id"), *_FORM).agg(F.count(F.lit(1)).alias("weight"), F.max("tokens").alias("tokens"), F.collect_set("raw").alias("raws")))
    clusters = star_clusters(forms.select("id", "weight"), materialize(link_forms(forms)))
    placed = with_id.join(clusters.withColumnRenamed("id", "form"), "form", "left").withColumn("centre", F.coalesce("centre", "form"))
    placed = materialize(placed)
    placed = placed.join(given_spellings(placed), ["centre", "given"], "left").withColumn("given", F.coalesce("main", "given"))
    # full given and middle names of a cluster: as many as its people, not as its rows
    parts = placed.groupBy("centre").agg(F.countDistinct("given").alias("n_given"), F.countDistinct("middle").alias("n_middle"))
    entity = F.concat_ws(
        "|", F.col("centre").cast("string"), F.when(F.col("n_given") > 1, F.coalesce("given", F.lit("?"))).otherwise(""), F.when(F.col("n_middle") > 1, F.coalesce("middle", F.lit("?"))).otherwise("")
    )
    return placed.join(parts, "centre").select("name_id", "kind", entity.alias("entity"))


def linked_pairs(entity: DataFrame) -> DataFrame:
    """name_id_a < name_id_b for every two names of one entity.

    An entity of more than ``PAIRS_OF`` names is joined in as many parts as it has so many names, each part with all of it,
    so that one with a third of all rows spreads over tasks.
    """
    rows = materialize(entity.select("entity", "kind", "name_id"))
    large = rows.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_OF).select("entity", "kind", F.ceil(F.col("n") / PAIRS_OF).cast("int").alias("parts"))
    parted = rows.join(large, ["entity", "kind"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = parted.select("entity", "kind", F.pmod(F.xxhash64("name_id"), F.col("parts")).cast("int").alias("part"), F.col("name_id").alias("name_id_a"))
    b = parted.select("entity", "kind", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name_id").alias("name_id_b"))
    return a.join(b, ["entity", "kind", "part"]).filter("name_id_a < name_id_b").select("name_id_a", "name_id_b")
