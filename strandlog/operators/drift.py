"""Schemas that drift between the files of a feed: match fields by similarity flooding, report changes, unite the rows.

The schema of each file is a graph: a root, a node per field and, below fields that hold objects, a node per
inner key to a depth of ``NESTING``; edges lead to the node's JSON types, to the words of its name and to its values. For two
successive files the pairwise connectivity graph joins pairs of nodes that are reached by edges of one label.
Scores start where something is known: at pairs of names by their likeness, at pairs of values by the share of
accessions that carry equal ones. From there they flow along the edges until they converge, so a pair of fields is judged by
its values, its inner keys, its types and its words together. A field may also pair with its absence, whose
values start at ``ABSENT``. From the converged scores a consistent set of correspondences is selected over all
fields, best first; where a field that is gone is matched to a new one, that is a rename.

Lines are parsed once. Only schema rows (fields x files of one feed, with counts of agreeing values) reach a Python task;
lines and values are aggregated in the JVM. A feed that holds a third of all lines is therefore a few
rows more, not a large group.

Defined results: a line that is null or no JSON object with an object under ``metadata``, or of no feed or file, gives no field; repeated
lines count once; a file whose predecessor by number is absent is compared with nothing; field names
are case-sensitive; null values give a field no type; values compare by their text, so a field may change its name and its type at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.session import materialize

FEED = ["mirror", "organism"]
#: what the absence of a field starts with, on the scale of shares of accessions with equal values
ABSENT = 0.88
#: what equal names start with on that scale, unless they are the same
NAME_WEIGHT = 0.2
#: weight of the edges to types, words and the root beside those to values
SIDE_WEIGHT = 0.5
#: weight of the edges between the values of an object and those of its inner keys; inner values that are all equal count like equal objects
INNER_WEIGHT = 3.2
#: levels of inner keys that are nodes of their own
NESTING = 2
#: parts the path of an inner key
_INNER = "\x1f"
_ROUNDS, _EPSILON = 50, 1e-5


#: JSON types, in the order of their bits in a set of types
TYPES = ("string", "number", "boolean", "array", "object")


_PREFIX = {"ST": "string", "BO": "boolean", "AR": "array", "OB": "object", "BI": "number", "DE": "number", "DO": "number", "FL": "number", "IN": "number"}


def json_type(v: Column) -> Column:
    """string, number, boolean, array or object of a variant; null for JSON null. The variant is looked at once."""
    names = F.create_map(*(F.lit(x) for pair in _PREFIX.items() for x in pair))
    return F.element_at(names, F.substring(F.schema_of_variant(v), 1, 2))


def metadata(lines: DataFrame) -> DataFrame:
    """mirror, organism, file_no, line_id, m: the metadata object of each well-formed line as map<string, variant>."""
    v = F.try_variant_get(F.try_parse_json("line"), "$.metadata", "map<string,variant>")
    return lines.select(*FEED, "file_no", "line_id", v.alias("m")).filter("m is not null and mirror is not null and organism is not null and file_no is not null")


def _text(v: Column) -> Column:
    """A value as text: a string without quotes, any other value as JSON; null for JSON null."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(json_type(v).isNotNull(), F.to_json(v)))


def read_fields(lines: DataFrame) -> DataFrame:
    """mirror, organism, file_no, accession, paths, types, values: of each well-formed line its fields and inner keys, a bit for the type of each (0 for null) and the hash of its text."""
    bits = F.create_map(*(F.lit(x) for k, name in enumerate(TYPES) for x in (name, 1 << k)))
    bit = lambda v: F.coalesce(F.element_at(bits, F.coalesce(json_type(v), F.lit(""))), F.lit(0))
    typed = lambda entries, above: F.transform(entries, lambda e: F.struct((F.concat(above, e["key"]) if above is not None else e["key"]).alias("p"), e["value"].alias("v"), bit(e["value"]).alias("t")))
    holds = 1 << TYPES.index("object")
    every = level = typed(F.map_entries("m"), None)
    rows = metadata(lines)
    for k in range(NESTING):
        name = f"__level{k}"
        rows = rows.withColumn(name, level)
        inner = F.transform(F.filter(F.col(name), lambda x: x["t"] == holds), lambda x: typed(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), F.concat(x["p"], F.lit(_INNER))))
        level = F.flatten(inner)
        every = F.col(name) if k == 0 else F.concat(every, F.col(name))
    rows = rows.withColumn("__all", F.concat(every, level))
    accession = F.try_variant_get(F.col("m")["accession"], "$", "string").alias("accession")
    part = lambda name, f: F.transform("__all", f).alias(name)
    return rows.select(*FEED, F.col("file_no").cast("int"), accession, part("paths", lambda x: x["p"]), part("types", lambda x: x["t"].cast("tinyint")), part("values", lambda x: F.when(x["t"] != 0, F.xxhash64(_text(x["v"])))))


def file_schemas(fields: DataFrame) -> DataFrame:
    """mirror, organism, file_no, field, types: a bit for each of ``TYPES`` that a non-null value has. Lines of one shape are one row before they are taken apart."""
    shapes = fields.select(*FEED, "file_no", "paths", "types").distinct()
    each = shapes.select(*FEED, "file_no", F.inline(F.arrays_zip(F.col("paths").alias("field"), F.col("types").alias("t"))))
    return each.groupBy(*FEED, "file_no", "field").agg(F.bit_or("t").cast("int").alias("types"))


def changed_fields(schemas: DataFrame) -> DataFrame:
    """mirror, organism, file_no, lost, new: fields that the next file lacks and that the previous file lacked.

    Only where a rename is possible: some field goes and some field comes between two successive files.
    """
    files = schemas.filter(~F.contains("field", F.lit(_INNER))).groupBy(*FEED, "file_no").agg(F.sort_array(F.collect_list("field")).alias("fields"))
    w = Window.partitionBy(*FEED).orderBy("file_no")
    near = lambda f, d: F.when(f("file_no").over(w) == F.col("file_no") + d, f("fields").over(w))
    beside = files.withColumn("before", near(F.lag, -1)).withColumn("after", near(F.lead, 1))
    none = F.array().cast("array<string>")
    pair = lambda old, cur: (F.size(F.array_except(old, cur)) > 0) & (F.size(F.array_except(cur, old)) > 0)
    lost = F.when(F.col("after").isNotNull() & pair(F.col("fields"), F.col("after")), F.array_except("fields", "after")).otherwise(none)
    new = F.when(F.col("before").isNotNull() & pair(F.col("before"), F.col("fields")), F.array_except("fields", "before")).otherwise(none)
    return beside.select(*FEED, "file_no", lost.alias("lost"), new.alias("new")).filter("size(lost) > 0 or size(new) > 0")


def value_agreement(fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """mirror, organism, file_no, gone, new, same, compared: for each field gone since the previous file and each new one, and for the inner keys of both.

    ``same`` counts the accessions with equal non-null values, ``compared`` those where either is non-null. A line ships the hashes of
    its changed fields under their numbers in the lists of changes, names only of inner keys.
    """
    changed = materialize(changed_fields(schemas))  # a row per file with changes, read twice
    top = lambda p: F.substring_index(p, _INNER, 1)
    number = lambda names: lambda p: F.array_position(names, top(p)).cast("smallint")
    zipped = F.arrays_zip(F.col("paths").alias("p"), F.col("values").alias("v"))

    def held(names: str) -> Column:
        mine = F.filter(zipped, lambda x: F.array_contains(F.col(names), top(x["p"])))
        return F.transform(mine, lambda x: F.struct(number(F.col(names))(x["p"]).alias("i"), F.when(F.contains(x["p"], F.lit(_INNER)), F.substring(x["p"], F.length(top(x["p"])) + 1, F.length(x["p"]))).alias("s"), x["v"].alias("v")))

    rows = fields.filter("accession is not null").join(changed, [*FEED, "file_no"]).select(*FEED, "file_no", "accession", held("lost").alias("gs"), held("new").alias("ns"))
    none = F.lit(None).cast("array<struct<i:smallint,s:string,v:bigint>>")
    # a line serves the comparison with the next file by what it loses there, and that with the previous one by what it adds
    sides = F.array(F.struct((F.col("file_no") + 1).alias("file_no"), F.col("gs").alias("gs"), none.alias("ns")), F.struct(F.col("file_no"), none.alias("gs"), F.col("ns").alias("ns")))
    halves = rows.select(*FEED, "accession", F.inline(sides)).filter("size(gs) > 0 or size(ns) > 0")
    both = halves.groupBy(*FEED, "file_no", "accession").agg(F.max("gs").alias("gs"), F.max("ns").alias("ns")).filter("gs is not null and ns is not null")
    # an accession's gone and new fields are as many as a schema is wide; fields pair with fields, inner keys with inner keys
    pair = both.select(*FEED, "file_no", F.explode("gs").alias("g"), "ns").select(*FEED, "file_no", "g", F.explode("ns").alias("n")).filter("(g.s is null) = (n.s is null)")
    either = F.col("g.v").isNotNull() | F.col("n.v").isNotNull()
    counts = pair.groupBy(*FEED, "file_no", F.col("g.i").alias("i"), F.col("g.s").alias("gs"), F.col("n.i").alias("j"), F.col("n.s").alias("ns")).agg(F.count_if(F.col("g.v") == F.col("n.v")).alias("same"), F.count_if(either).alias("compared"))
    names = lambda c, d: changed.select(*FEED, (F.col("file_no") + d).alias("file_no"), F.col(c).alias(f"{c}_names"))
    named = counts.join(names("lost", 1), [*FEED, "file_no"]).join(names("new", 0), [*FEED, "file_no"])
    full = lambda c, i, inner: F.concat(F.element_at(f"{c}_names", F.col(i).cast("int")), F.coalesce(F.col(inner), F.lit("")))
    return named.select(*FEED, "file_no", full("lost", "i", "gs").alias("gone"), full("new", "j", "ns").alias("new"), "same", "compared")


@lru_cache(maxsize=100_000)
def _words(name: str) -> frozenset[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", name)
    return frozenset(p.lower() for p in parts)


@lru_cache(maxsize=1_000_000)
def _likeness(a: str, b: str) -> float:
    """Dice coefficient of the padded trigrams of two names, without case and separators."""
    ga, gb = ({f"##{x}##"[i : i + 3] for i in range(len(x) + 2)} for x in (re.sub(r"[\W_]", "", s).lower() for s in (a, b)))
    return 2 * len(ga & gb) / (len(ga) + len(gb))


Schema = dict[str, tuple[str, ...]]
Pair = tuple[str | None, str | None]


def _children(schema: Schema) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for path in schema:
        if _INNER in path:
            out.setdefault(path.rsplit(_INNER, 1)[0], []).append(path)
    return out


def flood(old: Schema, new: Schema, agreement: dict[tuple[str, str], float], rounds: int = _ROUNDS) -> dict[Pair, float]:
    """Similarity flooding between two schemas (path -> JSON types); the converged scores of pairs of fields.

    Pairs are every field that both have with itself, every field gone with every new one, and each of these with its
    absence (None). Pairs of a field that both have with another are left out: the field itself takes it in any selection.
    agreement: the share of equal values of pairs of paths.
    """
    gone, came = ([p for p in sorted(x) if p not in y] for x, y in ((old, new), (new, old)))
    below_old, below_new = _children(old), _children(new)
    pairs: list[Pair] = [(p, p) for p in sorted(old) if p in new]
    pairs += [(a, b) for a in gone for b in came if a.count(_INNER) == b.count(_INNER)]
    pairs += [(a, None) for a in gone] + [(None, b) for b in came]
    at = {p: k for k, p in enumerate(pairs)}
    n = len(pairs)
    start: list[float] = []
    values: list[tuple[int, float]] = []
    edges: list[tuple[int, int, float]] = []
    hubs: dict[tuple[str, str], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        types = set(old[a]) & set(new[b]) if a is not None and b is not None else set(old[a] if a is not None else new[b])
        for t in types:
            hubs.setdefault(("type", t), []).append(k)
        hubs.setdefault(("root", ""), []).append(k)
        if a is None or b is None:
            start.append(0.0)
            values.append((k, ABSENT))
            continue
        for w in _words(a) & _words(b):
            hubs.setdefault(("word", w), []).append(k)
        start.append(1.0 if a == b else NAME_WEIGHT * _likeness(a, b))
        values.append((k, 1.0 if a == b else agreement.get((a, b), 0.0)))
    held = {k: n + i for i, (k, _) in enumerate(values)}
    for k, (a, b) in enumerate(pairs):
        # where objects are never equal as wholes, what they hold is equal as far as their inner keys are
        inner = [at[c, d] for c in below_old.get(a, ()) for d in below_new.get(b, ()) if (c, d) in at] if a != b and a is not None and b is not None else []
        if inner and not agreement.get((a, b)) and old[a] == new[b] == ("object",):
            for p in inner:
                edges += [(held[p], held[k], INNER_WEIGHT / max(len(below_old[a]), len(below_new[b]))), (held[k], held[p], SIDE_WEIGHT / len(inner))]
    nodes = n + len(values) + len(hubs)
    sigma0 = np.zeros(nodes)
    sigma0[:n] = start
    for i, (k, share) in enumerate(values):
        sigma0[n + i] = share
        edges += [(k, n + i, 1.0), (n + i, k, 1.0)]
    fan: dict[tuple[str, int], int] = {}
    for (label, _), members in hubs.items():
        for k in members:
            fan[label, k] = fan.get((label, k), 0) + 1
    for h, ((label, _), members) in enumerate(hubs.items(), n + len(values)):
        for k in members:
            edges += [(k, h, SIDE_WEIGHT / fan[label, k]), (h, k, SIDE_WEIGHT / len(members))]
    if not n:
        return {}
    where, to, weight = (np.array(x) for x in zip(*edges, strict=True))
    sigma = sigma0.copy()
    for _ in range(rounds):
        base = sigma0 + sigma
        nxt = base + np.bincount(to, weights=weight * base[where], minlength=nodes)
        nxt /= max(nxt[:n].max(), 1e-12)
        moved = np.abs(nxt - sigma).max()
        sigma = nxt
        if moved < _EPSILON:
            break
    return dict(zip(pairs, sigma[:n].tolist(), strict=True))


def select_matches(scores: dict[Pair, float]) -> list[Pair]:
    """A consistent set of correspondences: best score first, each field at most once, ties by name. Fields that go with their absence are left out."""
    used_a, used_b, out = set(), set(), []
    for (a, b), _ in sorted(scores.items(), key=lambda x: (-x[1], x[0][0] is None or x[0][1] is None, x[0][0] or "", x[0][1] or "")):
        if (a is None or a not in used_a) and (b is None or b not in used_b):
            used_a.add(a)
            used_b.add(b)
            if a is not None and b is not None:
                out.append((a, b))
    return out


def renames(old: Schema, new: Schema, agreement: dict[tuple[str, str], float]) -> dict[str, str]:
    """new field -> old field, among the top fields gone and new, as selected from the flooded scores."""
    gone, came = ({p for p in x if p not in y and _INNER not in p} for x, y in ((old, new), (new, old)))
    if not gone or not came:
        return {}
    # inner keys matter below the fields that go or come
    mine = lambda x, keep: {p: t for p, t in x.items() if _INNER not in p or p.split(_INNER, 1)[0] in keep}
    return {b: a for a, b in select_matches(flood(mine(old, gone), mine(new, came), agreement)) if a in gone and b in came}


_OUT = "mirror string, organism string, file_no bigint, field string, change string, new_field string, origin string"


def _feed_changes(rows_of_feed: pd.DataFrame) -> list[tuple]:
    """Changes and the united name (origin) of every field of one feed; change 'same' rows only carry the origin."""
    by_file: dict[int, Schema] = {}
    shares: dict[int, dict[tuple[str, str], float]] = {}
    for no, field, types, gone, new, same, compared in zip(*(rows_of_feed[c] for c in _EVIDENCE), strict=True):
        if field is not None:
            by_file.setdefault(int(no), {})[field] = tuple(t for k, t in enumerate(TYPES) if int(types) >> k & 1)
        elif compared:
            shares.setdefault(int(no), {})[(gone, new)] = same / compared
    rows: list[tuple] = []
    # of each field of the previous file: the types it last had, and the name it had when it was added
    last: dict[str, tuple[str, ...]] = {}
    origin: dict[str, str] = {}
    for no in sorted(by_file):
        here, old = by_file[no], by_file.get(no - 1)
        if old is None:
            last, origin = {}, {}
            renamed: dict[str, str] = {}
        else:
            renamed = renames(old, here, shares.get(no, {}))
            rows += [(no, f, "removed", f, None) for f in sorted(set(old) - set(here) - set(renamed.values())) if _INNER not in f]
        now_last, now_origin = {}, {}
        for f in sorted(here):
            if _INNER in f:
                continue
            was = renamed.get(f, f if old is not None and f in old else None)
            now_origin[f] = origin.get(was, was) if was is not None else f
            types = here[f]
            earlier = last.get(was, ()) if was is not None else ()
            if f in renamed:
                rows.append((no, was, "renamed", f, now_origin[f]))
            elif old is not None and was is None:
                rows.append((no, f, "added", f, now_origin[f]))
            if types and earlier and types != earlier:
                rows.append((no, was, "type_changed", f, now_origin[f]))
            rows.append((no, f, "same", f, now_origin[f]))
            now_last[f] = types or earlier
        last, origin = now_last, now_origin
    return rows


_EVIDENCE = ["file_no", "field", "types", "gone", "new", "same", "compared"]


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Schema and agreement rows, those of a feed one after the other, to the changes of each feed; a feed may go on in the next batch."""
    columns = [*FEED, "file_no", "field", "change", "new_field", "origin"]
    feed: tuple | None = None
    held: list[pd.DataFrame] = []

    def finished() -> list[tuple]:
        return [(*feed, *r) for r in _feed_changes(pd.concat(held, ignore_index=True))] if held else []

    for b in batches:
        names = ["field", "gone", "new"]
        b[names] = b[names].astype(object).where(b[names].notna(), None)
        rows: list[tuple] = []
        for key, mine in b.groupby(FEED, sort=False):
            if key != feed:
                rows += finished()
                feed, held = key, []
            held.append(mine)
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame(finished(), columns=columns)


def _evolution(lines: DataFrame) -> DataFrame:
    fields = materialize(read_fields(lines))  # lines are parsed here and nowhere else
    schemas = materialize(file_schemas(fields))  # one row per file and field, read three times
    pairs = value_agreement(fields, schemas)
    # these rows are few but each feed takes time, so they are spread by number, not coalesced by size
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    evidence = schemas.unionByName(pairs, allowMissingColumns=True).select(*FEED, *_EVIDENCE)
    return evidence.repartition(n, *FEED).sortWithinPartitions(*FEED).mapInPandas(_changes, _OUT)


def schema_changes(lines: DataFrame) -> DataFrame:
    """mirror, organism, file_no, field, change, new_field: every field renamed, removed, added or changed in type."""
    return _evolution(lines).filter("change != 'same'").drop("origin")


def united(lines: DataFrame) -> DataFrame:
    """One consistent long table: mirror, organism, file_no, line_id, accession, field, value.

    ``field`` is the name under which a field was added to the feed, followed through its renames; ``value`` is
    text: a string without quotes, any other value as JSON. Null values are left out.
    """
    names = _evolution(lines).filter("change = 'same'").select(*FEED, "file_no", F.col("new_field").alias("name"), "origin")
    # the names of a file travel as one map, so lines are not exploded before the join
    maps = names.groupBy(*FEED, "file_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "origin"))).alias("origins"))
    text = lambda v: F.when(json_type(v) == "string", F.try_variant_get(v, "$", "string")).when(json_type(v).isNotNull(), F.to_json(v))
    rows = F.transform(F.map_entries("m"), lambda e: F.struct(F.element_at("origins", e["key"]).alias("field"), text(e["value"]).alias("value")))
    accession = F.try_variant_get(F.col("m")["accession"], "$", "string").alias("accession")
    return metadata(lines).join(maps, [*FEED, "file_no"]).select(*FEED, "file_no", "line_id", accession, F.inline(rows)).filter("value is not null")
