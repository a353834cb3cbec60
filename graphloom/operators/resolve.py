"""Name resolution as prioritised equi-joins (C).

Every cascade is a union of candidate joins, each tagged with its priority; a request keeps the candidates of the least
priority that has any. Files, names and members are join keys, so nothing is looked up row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed list: names in type expressions that are no classes.
TYPING_NOISE = ("Any", "None", "Optional", "Union", "Literal", "Annotated", "Final", "ClassVar", "Self", "Type", "list", "dict", "set", "tuple")


def _first(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidates(by..., prio, target, ord) of the least priority."""
    least = F.min("prio").over(Window.partitionBy(*by))
    return candidates.withColumn("_p", least).where("prio = _p").drop("_p")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """`modules(file, module, dots)` with `target_file`: the module's own file, or else its package's."""
    parts = F.split("file", "/")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest("dots", F.lit(1)), F.lit(0)))
    own = F.split(F.col("module"), r"\.")
    path = F.when(F.col("dots") > 0, F.concat(base, F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(own))).otherwise(own)
    ways = F.array(F.struct(F.lit(0).alias("prio"), F.lit(".py").alias("end")), F.struct(F.lit(1).alias("prio"), F.lit("/__init__.py").alias("end")))
    key = ["file", "module", "dots"]
    want = modules.select(*key).distinct().withColumn("_w", F.explode(ways)).select(*key, F.concat(F.array_join(path, "/"), "_w.end").alias("path"), "_w.prio")
    found = want.join(files.select("path").distinct(), "path").groupBy(*key).agg(F.min_by("path", "prio").alias("target_file"))
    return modules.join(found, key, "left")


def bindings(imports: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """`file, alias, seq, kind, symbol, target_file, target_node`.

    `from p import m` is the module p.m where there is one, and else the symbol m of p. The last import of an alias
    counts; wildcards add up.
    """
    plain = imports.where("symbol IS NULL").withColumn("kind", F.lit("module"))
    named = imports.where("symbol IS NOT NULL")
    deep = named.where("symbol <> '*'").withColumn("_m", F.col("module"))
    deep = module_files(deep.withColumn("module", F.when(F.col("_m") == "", F.col("symbol")).otherwise(F.concat("_m", F.lit("."), "symbol"))), files)
    as_module = deep.where("target_file IS NOT NULL").select("file", "seq", "alias", "symbol", F.lit("module").alias("kind"), "target_file")
    rest = module_files(named, files).join(as_module.select("file", "seq"), ["file", "seq"], "left_anti")
    as_symbol = rest.select("file", "seq", "alias", "symbol", F.lit("symbol").alias("kind"), "target_file")
    rows = _union(module_files(plain, files).select("file", "seq", "alias", "symbol", "kind", "target_file"), as_module, as_symbol)
    known = nodes.select(F.col("id").alias("target_node"))
    want = F.when((F.col("kind") == "symbol") & (F.col("symbol") != "*"), F.concat("target_file", F.lit("::"), "symbol"))
    rows = rows.withColumn("_want", want).join(known, F.col("_want") == F.col("target_node"), "left").drop("_want")
    stars = rows.where("alias = '*'").dropDuplicates(["file", "alias", "target_file"])
    w = Window.partitionBy("file", "alias").orderBy(F.col("seq").desc())
    last = rows.where("alias <> '*'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return stars.unionByName(last)


def import_edges(bound: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.where("type = 'file'").select(F.col("id").alias("dst"))
    rows = bound.where("target_file IS NOT NULL").select(F.col("file").alias("src"), F.col("target_file").alias("dst")).distinct()
    return rows.join(known, "dst", "left_semi").select("src", "dst", F.lit("IMPORTS").alias("type"), F.lit(None).cast("string").alias("confidence"))


def import_targets(requests: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """C4: nodes that an imported name - or a member of it - means: `requests(req, file, name, member)` to `req, target, ord`."""
    ids = nodes.select(F.col("id").alias("target"))
    classes = nodes.where("type = 'class'").select(F.col("id").alias("target_node"))
    b = bound.select("file", F.col("alias").alias("name"), "seq", "kind", "symbol", "target_file", "target_node")
    hit = requests.join(b, ["file", "name"])
    with_member, plain = hit.where("member IS NOT NULL"), hit.where("member IS NULL")
    on_class = with_member.join(classes, "target_node", "left_semi").select("req", F.concat("target_node", F.lit("."), "member").alias("target"), F.lit(0).alias("ord"))
    in_file = with_member.select("req", F.concat("target_file", F.lit("::"), "member").alias("target"), F.lit(1).alias("ord"))
    symbol = plain.where("target_node IS NOT NULL").select("req", F.col("target_node").alias("target"), F.lit(2).alias("ord"))
    module = plain.where("target_node IS NULL AND kind = 'module'").select("req", F.concat("target_file", F.lit("::"), "name").alias("target"), F.lit(3).alias("ord"))
    stars = requests.where("member IS NULL").join(bound.where("alias = '*'").select("file", F.col("target_file").alias("star")), "file").where("star IS NOT NULL")
    direct = stars.select("req", F.concat("star", F.lit("::"), "name").alias("target"), F.lit(4).alias("ord"))
    inner = b.select(F.col("file").alias("star"), "name", "symbol", F.col("target_file").alias("_f"), F.col("target_node").alias("_n"))
    again = stars.join(inner, ["star", "name"]).select("req", F.coalesce("_n", F.concat("_f", F.lit("::"), F.coalesce("symbol", "name"))).alias("target"), F.lit(5).alias("ord"))
    return _union(on_class, in_file, symbol, module, direct, again).join(ids, "target", "left_semi").groupBy("req", "target").agg(F.min("ord").alias("ord"))


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Whether two paths share their folder, and how many leading parts they share."""
    pa, pb = F.split(a, "/"), F.split(b, "/")
    folder = lambda p: F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/")
    pairs = F.zip_with(pa, pb, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    run = F.aggregate(pairs, F.struct(F.lit(1).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] * x).alias("on"), (s["n"] + s["on"] * x).alias("n")), lambda s: s["n"])
    return folder(pa) == folder(pb), run


def nearest(candidates: DataFrame, by: str = "req", k: int = 1) -> DataFrame:
    """Of `candidates(by, file, target, target_file)` the `k` nearest by path."""
    same, run = similarity(F.col("file"), F.col("target_file"))
    w = Window.partitionBy(by).orderBy(same.desc(), run.desc(), "target")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _named(requests: DataFrame, pool: DataFrame, same_file: bool) -> DataFrame:
    """Requests joined to `pool(name, target, target_file)` by name, within the file or anywhere."""
    p = pool.select("name", "target", "target_file")
    j = requests.join(p, "name")
    return j.where("file = target_file") if same_file else j


def base_classes(requests: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """`requests(req, file, expr)` to `req, target`: imported member, imported name, own file, nearest anywhere."""
    r = requests.withColumn("expr", F.trim("expr")).where("expr <> ''")
    dotted = F.col("expr").contains(".")
    last = F.element_at(F.split("expr", r"\."), -1)
    r = r.select("req", "file", F.when(dotted, F.substring_index("expr", ".", 1)).alias("q"), F.when(dotted, last).otherwise(F.col("expr")).alias("name"))
    classes = nodes.where("type = 'class'").select("name", F.col("id").alias("target"), F.col("file").alias("target_file"))
    only = classes.select("target")
    member = import_targets(r.where("q IS NOT NULL").select("req", "file", F.col("q").alias("name"), F.col("name").alias("member")), bound, nodes)
    name = import_targets(r.select("req", "file", "name", F.lit(None).cast("string").alias("member")), bound, nodes)
    tag = lambda df, p: df.select("req", "target", F.lit(p).alias("prio"), "ord")
    own = _named(r, classes, True).select("req", "target", F.lit(2).alias("prio"), F.lit(0).alias("ord"))
    far = nearest(_named(r, classes, False)).select("req", "target", F.lit(3).alias("prio"), F.lit(0).alias("ord"))
    every = _union(tag(member, 0), tag(name, 1), own, far).join(only, "target", "left_semi")
    return every.groupBy("req").agg(F.min_by("target", F.struct("prio", "ord", "target")).alias("target"))


def type_classes(requests: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes that the first resolvable name of a type expression means: `requests(req, file, expr)` to `req, target`."""
    names = F.regexp_extract_all(F.coalesce("expr", F.lit("")), F.lit(r"([A-Za-z_][\w.]*)"), F.lit(1))
    each = requests.select("req", "file", F.posexplode(names).alias("pos", "token")).where(~F.col("token").isin(*TYPING_NOISE))
    each = each.select(F.concat_ws("\u0001", "req", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("_t"), "req", "file", F.col("token").alias("expr"), "pos")
    got = base_classes(each.select(F.col("_t").alias("req"), "file", "expr"), bound, nodes)
    j = each.select("_t", F.col("req").alias("_req"), "pos").join(got, F.col("_t") == got.req).select(F.col("_req").alias("req"), "pos", "target")
    return j.groupBy("req").agg(F.min_by("target", "pos").alias("target"))


def call_edges(defs: DataFrame, bound: DataFrame, low: bool = True) -> DataFrame:
    """CALLS edges `src, dst, type, confidence, seq` of all definitions."""
    nodes = defs.select("id", "type", "name", "file", "parent_class")
    c = defs.where("type = 'function'").select(F.col("id").alias("src"), "file", "parent_class", "hints", F.posexplode("calls").alias("seq", "c"))
    c = c.select("src", "file", "parent_class", "hints", "seq", F.trim("c.name").alias("name"), F.trim("c.qualifier").alias("q")).where("name <> ''")
    c = c.groupBy("src", "file", "parent_class", "name", "q").agg(F.min("seq").alias("seq"), F.first("hints").alias("hints"))
    c = c.withColumn("req", F.concat_ws("\u0001", "src", "name", "q"))
    functions = nodes.where("type <> 'file'").select("name", F.col("id").alias("target"), F.col("file").alias("target_file"), F.col("parent_class").alias("owner"))
    cand = lambda df, prio, conf: df.select("req", "target", F.lit(prio).alias("prio"), F.lit(conf).alias("confidence"))
    to_self = c.where("q = 'self' AND parent_class IS NOT NULL").alias("c").join(functions.alias("f"), ["name"]).where("file = target_file AND parent_class = owner")
    other = c.where("q <> '' AND NOT (q = 'self' AND parent_class IS NOT NULL)")
    expr = other.select("req", "file", F.coalesce(F.try_element_at("hints", "q"), F.col("q")).alias("expr"))
    typed = type_classes(expr, bound, nodes).withColumnRenamed("target", "_class").join(other.select("req", "name"), "req")
    typed = typed.select("req", F.concat("_class", F.lit("."), "name").alias("target")).join(functions.select("target"), "target", "left_semi")
    via = import_targets(other.select("req", "file", F.col("q").alias("name"), F.col("name").alias("member")), bound, nodes)
    bare = c.where("q = ''")
    top = _named(bare, functions.where("owner IS NULL"), True)
    inside = _named(bare, functions, True)
    imported = import_targets(bare.select("req", "file", "name", F.lit(None).cast("string").alias("member")), bound, nodes)
    parts = [cand(to_self, 0, "high"), cand(typed, 1, "high"), cand(via, 2, "high"), cand(top, 3, "high"), cand(inside, 4, "medium"), cand(imported, 5, "high")]
    if low:
        parts.append(cand(nearest(_named(c, functions, False)), 6, "low"))
    best = _first(_union(*parts), ["req"]).join(c.select("req", "src", "seq"), "req").where("src <> target")
    return best.select("src", F.col("target").alias("dst"), F.lit("CALLS").alias("type"), "confidence", "seq").distinct()


def one_edge_per_pair(edges: DataFrame) -> DataFrame:
    """C11: of `edges(src, dst, type, confidence, stage, seq)` the last written for each pair."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("type", "confidence"), F.struct("stage", "seq", "type")).alias("e")).select("src", "dst", "e.type", "e.confidence")


def code_graph(files: DataFrame, low: bool = True) -> tuple[DataFrame, DataFrame]:
    """B2, C: `nodes` and `edges` of `files(path, content)`; always built whole."""
    from .extract import definitions, imports, nodes, structure_edges

    # Parsed once; lost parts are parsed again.
    defs = definitions(files).persist()
    bound = bindings(imports(files), files, defs).persist()
    bases = defs.where("type = 'class'").select(F.col("id").alias("src"), "file", F.posexplode("bases").alias("seq", "expr"))
    bases = bases.withColumn("req", F.concat_ws("\u0001", "src", F.col("seq").cast("string")))
    parents = base_classes(bases.select("req", "file", "expr"), bound, defs).join(bases.select("req", "src", "seq"), "req").where("src <> target")
    inherits = parents.select("src", F.col("target").alias("dst"), F.lit("INHERITS").alias("type"), F.lit(None).cast("string").alias("confidence"), "seq")
    staged = lambda df, k: df.withColumn("stage", F.lit(k))
    first = structure_edges(defs).unionByName(import_edges(bound, defs)).withColumn("seq", F.lit(0))
    edges = _union(staged(first, 0), staged(inherits, 1), staged(call_edges(defs, bound, low), 2))
    return nodes(defs), one_edge_per_pair(edges)
