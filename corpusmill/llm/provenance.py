"""Problem 4: generated, minified, vendored source files and data stored as code.

Method: belief propagation over the directory trees of the repositories. Files and directories are the nodes; a
node is handwritten, generated, minified, vendored or blob. A file's evidence comes from its content (markers
in the leading comment, repetition of line shapes, white space, share of names, notices of licences, a body equal to
that of another file in a vendored place) and its own name. Nothing in a file's evidence depends on its place: directories whose
names say that they hold third-party code are observed nodes, and what this means for the files below comes down the tree.
Parents and children are tied by a table of compatibilities. On a tree one pass upwards and one downwards give exact beliefs,
so parents, siblings and further relatives decide files whose own evidence is weak. An observed directory says nothing of what lies above it (projects keep third-party code in
such places), so the edge above it is cut.

Messages of files are summed per directory before any exchange of rows, so a directory with any number of files is one row of
five numbers; equal copies of a file in one directory speak once. Trees of up to ``max_dirs`` directories are solved whole, many
in one numpy pass of a task; larger ones level by level over the cluster, with the same result. Files meet their directory's belief
through a key that is salted for directories with very many files.

Null or blank content has no evidence and no case is made of it. A null or blank path puts the file at the root of its
repository; files without a repository name are a tree by path head, and without one a tree each. Repeated rows are judged each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.splits import path_head, repository
from corpusmill.llm.syntax import LEXERS, language_of_path
from corpusmill.operators.relate import salted_join
from corpusmill.session import cut_lineage, ship_by_value, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: P(label of child | label of parent), rows and columns in the order of LABELS. What lies under third-party code is third-party
#: code; tools and data fill directories of their own less strictly; a handwritten directory may hold a little of everything.
COMPATIBLE = (
    (0.880, 0.025, 0.020, 0.055, 0.020),
    (0.300, 0.640, 0.020, 0.020, 0.020),
    (0.300, 0.020, 0.640, 0.020, 0.020),
    (0.012, 0.012, 0.012, 0.952, 0.012),
    (0.350, 0.020, 0.020, 0.020, 0.590),
)
#: The same where the child is a directory without a telling name: that third-party code begins there is rare.
DIRECTORIES = ((0.930, 0.025, 0.020, 0.005, 0.020), *COMPATIBLE[1:])
#: Of a repository as a whole: it is somebody's own work as a rule.
PRIOR = (0.939, 0.020, 0.020, 0.001, 0.020)
#: Log-likelihood of a directory that is observed to be third-party code, against any other label.
OBSERVED = 50.0
#: A file without a notice, against that it is third-party code.
NO_NOTICE = -0.8
#: Directory names and what they speak for, as log-likelihoods by label.
VENDOR_DIRS = "node_modules vendor _vendor vendored third_party third-party thirdparty 3rdparty 3rd_party external externals deps site-packages dist-packages bower_components jspm_packages godeps pods carthage"
HINT_DIRS = {"generated": "gen generated autogen codegen wire pb proto_gen", "minified": "dist build static public min", "blob": "data assets res fixtures"}
#: Phrases of generators and of libraries' licence notes; they count in the leading comment only.
GENERATED = r"auto-?\s?generated|automatically (?:generated|created|written|produced)|code generated by|@generated|generated (?:by|from|file|code|with|using)|do not edit|don't edit|manual edits|changes will be lost|edits (?:are|will be) (?:lost|overwritten)|will be overwritten|regenerate with|machine[- ]generated"
#: Families of cues in the leading comment by which libraries give their origin and terms, with their log-likelihoods. One family alone
#: is what any file may say; a notice has two or more.
NOTICES = (
    (r"\bspdx-license-identifier\b", 5.0),
    (r"\blicen[sc](?:e|es|ed|ing)\b", 2.5),
    (r"\bredistribut\w+", 2.5),
    (r"\bcopyright\b|\(c\)|\u00a9|\ball rights reserved\b", 2.5),
    (r"\b(?:authors|contributors|maintainers)\b", 1.5),
    (r"\b(?:permission|permitted|warrant(?:y|ies)|as is|provided that|this notice|notice)\b", 1.5),
    (r"\b(?:mit|bsd|apache|gnu|l?gpl|mpl|isc|zlib|boost)\b", 1.5),
    (r"\bpart of (?!this\b|the (?:same|whole)\b)[\w.-]+", 2.0),
    (r"\bupstream\b|\bhttps?://|\bvendored\b|\bthird[- ]party\b", 1.5),
    (r"^[^\w\n]*+\w[\w.@/-]*+(?: -)?(?:,? (?:release|version))? v?\d+\.\d+\.\d+\b", 3.0),
)
NOTICE_BASE = 2.5
GENERATED_NAMES = r"(?:_pb2?(?:_grpc)?|\.pb|_autogen|[._-]generated|_gen|_tables|\.g|\.designer|_img|parsetab|lextab)\.[a-z]+$"
MINIFIED_NAMES = r"(?:[.-]min|\.bundle|\.pack(?:ed)?|[.-]prod(?:uction)?)\.[a-z]+$"


def make_features():
    """A function (path, language, content) -> (evidence by label, digest of the body without comments, its size, notice?)."""
    lexers = {name: re.compile(p, re.S) for name, p in LEXERS.items()}
    lead = re.compile(r"\A\s*(?:(?:#(?!include|define|if|pragma)[^\n]*(?:\n|\Z)|//[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|;[^\n]*\n|--[^\n]*\n)\s*)+", re.S)
    generated, notices = re.compile(GENERATED, re.I), [(re.compile(p, re.I | re.M), w) for p, w in NOTICES]
    generated_name, minified_name = re.compile(GENERATED_NAMES, re.I), re.compile(MINIFIED_NAMES, re.I)
    digits = re.compile(r"-?\d+(?:\.\d+)?(?:,\s?-?\d+(?:\.\d+)?)*+")
    literal_numbers = re.compile(r"\b\d[\w.]*+")
    name_chars = re.compile(r"[A-Za-z_$]\w*+")
    blank = str.maketrans("", "", " \t\n\r\f\v")
    taken = [0]

    def take(m: re.Match) -> str:
        found = m.group()
        if found[0] in "\"'`":
            taken[0] += len(found)
            return "\x02"
        return " " if found[0] == "#" or len(found) > 1 else found

    def slope(x: float, at: float, width: float, high: float, low: float) -> float:
        """From ``high`` well below ``at`` to ``low`` well above it."""
        t = min(1.0, max(0.0, (x - at + width) / (2 * width)))
        return high + (low - high) * t

    def trusted(value: float, n: float, enough: float, none: float) -> float:
        """``value`` as far as ``n`` observations carry it: all of it from ``enough`` on, ``none`` with hardly any."""
        return none + (value - none) * min(1.0, max(0.0, 2 * n / enough - 1))

    def notice(head: str) -> float:
        found = [w for p, w in notices if p.search(head)] if head else []
        return min(8.0, sum(found) + NOTICE_BASE) if len(found) > 1 else NO_NOTICE

    def features(path: str | None, language: str | None, content: str | None):
        if content is None or not content.strip():
            return [0.0] * 5, None, 0, False
        m = lead.match(content)
        head = m.group() if m else ""
        taken[0] = 0
        body = lexers.get(language, lexers["javascript"]).sub(take, content)
        dense = body.translate(blank)
        size = len(dense) + taken[0]
        names = sum(map(len, name_chars.findall(literal_numbers.sub("", body)))) / max(1, size)
        spaces = 1 - len(dense) / max(1, len(body))
        # Lines of numbers alone are data, not repeated statements.
        shapes = [s for s in (line.strip() for line in digits.sub("0", body).split("\n")) if s and name_chars.search(s)]
        variety = len(set(shapes)) / max(1, len(shapes))
        name = (path or "").rstrip()
        noted = notice(head)
        evidence = [
            0.0,
            (7.0 if generated.search(head) else 0.0) + trusted(slope(variety, 0.17, 0.06, 6.0, -2.5), len(shapes), 8, -1.0) + (1.5 if generated_name.search(name) else 0.0),
            trusted(slope(spaces, 0.10, 0.03, 7.0, -4.0), len(dense) if names > 0.3 else 0, 150, -4.0) + (2.0 if minified_name.search(name) else 0.0),
            noted,
            trusted(slope(names, 0.13, 0.03, 7.0, -4.0), size, 300, -4.0),
        ]
        return evidence, hashlib.md5(dense.encode("utf-8", "surrogatepass")).hexdigest(), size, noted > 0

    return features


def _features_udf():
    def featured(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        features = make_features()
        for paths, languages, texts in batches:
            rows = [features(*row) for row in zip(paths, languages, texts)]
            yield pd.DataFrame({"evidence": [r[0] for r in rows], "body": [r[1] for r in rows], "size": [r[2] for r in rows], "noted": [r[3] for r in rows]})

    ship_by_value()
    return F.pandas_udf(featured, "evidence array<double>, body string, size int, noted boolean")


def _log_sum(terms: Column) -> Column:
    """Logarithm of the sum of exponentials of an array; the array is bound once, so that nested messages stay small plans."""
    return F.transform(F.array(terms), lambda a: F.array_max(a) + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(a)))))[0]


def _weights(rows) -> Column:
    return F.array(*[F.array(*[F.lit(math.log(p)) for p in row]) for row in rows])


def _message_up(belief: Column, rows=COMPATIBLE) -> Column:
    """What a child with this belief tells its parent, by the parent's label."""
    return F.transform(_weights(rows), lambda row: _log_sum(F.zip_with(belief, row, lambda x, w: x + w)))


def _message_down(belief: Column, rows=COMPATIBLE) -> Column:
    """What a parent tells a child, by the child's label."""
    return F.transform(_weights(zip(*rows)), lambda row: _log_sum(F.zip_with(belief, row, lambda x, w: x + w)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _sums(array: str) -> Column:
    """Sum of arrays of five numbers, element by element."""
    return F.array(*[F.sum(F.col(array)[k]) for k in range(5)])


def directory_of(path: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.regexp_replace(path, r"(?U)^\s+|\s+$", ""), r"\\", "/"))
    return F.coalesce(F.regexp_replace(F.regexp_extract(clean, r"^(?:\./|/)*(.*)/[^/]*$", 1), r"/{2,}", "/"), F.lit(""))


def _last(directory: Column) -> Column:
    return F.regexp_extract(directory, r"([^/]*)$", 1)


def _observed(directory: Column) -> Column:
    """Whether the directory's name says that it holds third-party code."""
    return _last(directory).isin(VENDOR_DIRS.split())


def _directory_evidence(directory: Column) -> Column:
    """Log-likelihoods of a directory's own name."""
    last = _last(directory)
    out = [F.lit(0.0)] * 5
    for label, names in HINT_DIRS.items():
        out[LABELS.index(label)] = F.when(last.isin(names.split()), F.lit(0.7)).otherwise(F.lit(0.0))
    out[LABELS.index("vendored")] = F.when(_observed(directory), F.lit(OBSERVED)).otherwise(F.lit(0.0))
    return F.array(*out)


def file_evidence(code: DataFrame) -> DataFrame:
    """file_id, repo, dir, blank, body and e (evidence by label) of every row, with what equal bodies in vendored places add."""
    path = F.col("max_stars_repo_path")
    alone = F.concat(F.lit("?"), F.coalesce(F.col("file_id").cast("string"), F.lit("")))
    repo = F.coalesce(repository(F.col("max_stars_repo_name")), repository(F.col("repo_name")), F.concat(F.lit("?"), path_head(path)), alone)
    code = spread(code.select("file_id", "max_stars_repo_name", "repo_name", "max_stars_repo_path", "content"))
    rows = code.select("file_id", repo.alias("repo"), directory_of(path).alias("dir"), _features_udf()(path, language_of_path(path), F.col("content")).alias("f"), F.coalesce(~F.col("content").rlike(r"(?U)\S"), F.lit(True)).alias("blank"))
    in_vendor = F.col("dir").rlike(r"(?:^|/)(?:" + "|".join(VENDOR_DIRS.split()) + r")(?:/|$)")
    flat = cut_lineage(rows.select("file_id", "repo", "dir", "blank", "f.body", "f.size", (F.col("f.noted") | in_vendor).alias("witness"), F.col("f.evidence").alias("e")))
    bodies = flat.where("body is not null").groupBy("body").agg(F.count_if("witness").alias("witnesses"), F.count("*").alias("n")).where("witnesses > 0")
    bodies = cut_lineage(bodies)
    joined = salted_join(flat, bodies.select("body", "witnesses"), ["body"], "file_id", bodies, how="left")
    # A body that another file in such a place has speaks as loud as a notice; short bodies may be equal by chance.
    others = F.coalesce(F.col("witnesses"), F.lit(0)) - F.when(F.col("witness"), 1).otherwise(0)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("size") - 100) / 100.0))
    added = F.when(others > 0, 7.0 * weight).otherwise(F.lit(-1e9))
    raised = F.transform("e", lambda x, k: F.when(k == LABELS.index("vendored"), F.greatest(x, added)).otherwise(x))
    return joined.select("file_id", "repo", "dir", "blank", "body", raised.alias("e"))


def solve_trees(depth: np.ndarray, parent: np.ndarray, evidence: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Exact log-beliefs of the nodes of many trees at once: one pass upwards and one downwards, level by level.

    ``parent`` holds row numbers, -1 for roots; ``evidence`` has a column per label; ``cut`` marks nodes that pass nothing to their parent
    and hear nothing from it.
    """
    table = np.log(np.array(DIRECTORIES))
    belief = evidence.astype(float).copy()
    told = np.zeros_like(belief)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for here in reversed(levels[1:]):
        here = here[~cut[here]]
        told[here] = np.logaddexp.reduce(belief[here][:, None, :] + table[None], axis=2)
        np.add.at(belief, parent[here], told[here])
    belief[levels[0]] += np.log(np.array(PRIOR))
    for here in levels[1:]:
        here = here[~cut[here]]
        above = belief[parent[here]] - told[here]
        belief[here] += np.logaddexp.reduce(above[:, :, None] + table[None], axis=1)
    return belief


def _solved(held: int):
    """mapInPandas function over directories sorted by repository: their beliefs. Whole repositories are gathered until ``held`` rows are there."""
    columns = [f"b{k}" for k in range(5)]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        keys = pd.Index(rows["repo"] + "\x00" + rows["dir"])
        up = keys.get_indexer(rows["repo"] + "\x00" + rows["parent"])
        depth = rows["depth"].to_numpy()
        out = pd.DataFrame(solve_trees(depth, np.where(depth > 0, up, -1), rows[columns].to_numpy(), rows["observed"].to_numpy(dtype=bool)), columns=columns)
        return pd.concat([rows[["repo", "dir", "n"]].reset_index(drop=True), out], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= held:
                rows = pd.concat(waiting, ignore_index=True)
                open_repo = rows["repo"] == rows["repo"].iloc[-1]
                if not open_repo.all():
                    yield solve(rows[~open_repo])
                waiting = [rows[open_repo]]
                size = len(waiting[0])
        if size:
            yield solve(pd.concat(waiting, ignore_index=True))

    return run


def _beliefs_by_level(nodes: DataFrame) -> DataFrame:
    """The beliefs of ``solve_trees`` for trees too large for one task: each level is a distributed pass."""
    keys = ["repo", "dir"]
    nothing = F.array(*[F.lit(0.0)] * 5)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up: dict[int, DataFrame] = {}
    told = None
    for level in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == level)
        if told is not None:
            here = here.join(told, keys, "left").select(*keys, "n", "depth", "parent", "observed", _plus(F.col("b"), F.coalesce("t", nothing)).alias("b"))
        up[level] = cut_lineage(here.select("*", F.when(F.col("observed"), nothing).otherwise(_message_up(F.col("b"), DIRECTORIES)).alias("u")))
        told = up[level].groupBy("repo", F.col("parent").alias("dir")).agg(_sums("u").alias("t"))
    prior = F.array(*[F.lit(math.log(p)) for p in PRIOR])
    settled = [cut_lineage(up[0].select(*keys, "n", _plus(F.col("b"), prior).alias("b")))]
    for level in range(1, deepest + 1):
        above = settled[-1].select("repo", F.col("dir").alias("parent"), F.col("b").alias("a"))
        heard = F.when(F.col("observed"), nothing).otherwise(_message_down(_minus(F.col("a"), F.col("u")), DIRECTORIES))
        settled.append(cut_lineage(up[level].join(above, ["repo", "parent"]).select(*keys, "n", _plus(F.col("b"), heard).alias("b"))))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def directory_beliefs(files: DataFrame, max_dirs: int = 1_000_000) -> DataFrame:
    """repo, dir, n (files directly in it) and b (log-beliefs) of every directory of the files and all above them."""
    keys = ["repo", "dir"]
    # Equal copies of a file in one directory are one node of the tree.
    spoken = files.groupBy(*keys, "body", "e").agg(F.count("*").alias("n")).select(*keys, "n", _message_up(F.col("e")).alias("m"))
    direct = spoken.groupBy(*keys).agg(F.sum("n").alias("n"), _sums("m").alias("m"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    lines = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    whole = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_append(lines, F.col("dir")))
    nothing = F.array(*[F.lit(0.0)] * 5)
    chain = direct.select("repo", F.col("dir").alias("own"), "n", "m", F.explode(whole).alias("dir"))
    mine = F.col("own") == F.col("dir")
    nodes = chain.select(*keys, F.when(mine, F.col("n")).otherwise(0).alias("n"), F.when(mine, F.col("m")).otherwise(nothing).alias("m")).groupBy(*keys).agg(F.sum("n").alias("n"), _sums("m").alias("m"))
    parent = F.when(F.col("dir").contains("/"), F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    nodes = cut_lineage(nodes.select(*keys, "n", depth.alias("depth"), parent.alias("parent"), _observed(F.col("dir")).alias("observed"), _plus(F.col("m"), _directory_evidence(F.col("dir"))).alias("b")))
    # At most one repository in max_dirs directories is large, which bounds this list.
    large = F.broadcast(nodes.groupBy("repo").agg(F.count("*").alias("d")).where(F.col("d") > max_dirs).select("repo"))
    some = bool(large.limit(1).count())
    small = nodes.join(large, "repo", "left_anti") if some else nodes
    flat = small.select(*keys, "n", "depth", "parent", "observed", *[F.col("b")[k].alias(f"b{k}") for k in range(5)]).repartition("repo").sortWithinPartitions("repo")
    kind = "repo string, dir string, n long, b0 double, b1 double, b2 double, b3 double, b4 double"
    solved = flat.mapInPandas(_solved(100_000), kind).select(*keys, "n", F.array(*[F.col(f"b{k}") for k in range(5)]).alias("b"))
    return cut_lineage(solved.unionByName(_beliefs_by_level(nodes.join(large, "repo", "left_semi")))) if some else cut_lineage(solved)


def file_labels(code: DataFrame, max_dirs: int = 1_000_000) -> DataFrame:
    """file_id, label and the belief in each label (p_<label>) of every row with content; label is null for blank content."""
    files = cut_lineage(file_evidence(code))
    beliefs = directory_beliefs(files, max_dirs)
    met = salted_join(files, beliefs.select("repo", "dir", "b"), ["repo", "dir"], "file_id", beliefs)
    heard = _message_down(_minus(F.col("b"), _message_up(F.col("e"))))
    decided = met.select("file_id", "blank", _plus(F.col("e"), heard).alias("q"))
    best = F.array_position("q", F.array_max("q")).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), best)
    share = F.transform(F.array("q"), lambda q: F.transform(q, lambda x: F.exp(x - F.array_max(q))))[0]
    shown = decided.select("file_id", F.when(~F.col("blank"), label).alias("label"), share.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return shown.select("file_id", "label", *[(F.col("w")[k] / total).alias(f"p_{name}") for k, name in enumerate(LABELS)])


def own_labels(code: DataFrame) -> DataFrame:
    """file_id and the label that a file's own evidence and the prior give, without its tree: what the propagation is compared with."""
    prior = F.array(*[F.lit(math.log(p)) for p in COMPATIBLE[0]])
    q = _plus(F.col("e"), prior)
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position(q, F.array_max(q)).cast("int"))
    return file_evidence(code).select("file_id", F.when(~F.col("blank"), label).alias("label"))


def found_machine_made(code: DataFrame) -> DataFrame:
    """file_id of every file with content that is most probably not handwritten."""
    return file_labels(code).where(F.col("label") != "handwritten").select("file_id")
