"""Problem 1: train, validation and test splits that keep related records together.

Method: owners are the nodes of a graph. A row that names two owners ties them. Components come from Hash-to-Min:
every node keeps a cluster of nodes; in each round the smallest member of a cluster is told to all its members and
all members are told to the smallest one, until nothing changes. Clusters are rows (node, member), never lists, and
only owners that some row ties to another one enter the rounds. Components then get a split by weighted rendezvous
hashing: each split draws -ln(u)/weight from a hash of the component and the split, and the smallest draw wins, so
the share of each split follows its weight and a component never moves unless a weight changes.

A repository name is the same in any letter case, with blanks around it, as ``owner/name``, ``owner/name.git`` or as an
https, ssh or scp-like address. A row with both names null or blank takes the repository ``owner/name`` its
path begins with, if some row names that repository; otherwise it stands alone, and its file id decides its
split. A name without an owner ties the rows that bear it. Null paths and repeated rows are allowed; each row gets one
result. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.relate import salted_join
from corpusmill.session import cut_lineage

BLANK = r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$"


def repository(name: Column) -> Column:
    """``owner/name`` in lower case from any written form; a bare name without owner stays bare; null for blank."""
    clean = F.lower(F.regexp_replace(name, BLANK, ""))
    clean = F.regexp_replace(clean, r"[?#].*$", "")
    clean = F.regexp_replace(clean, r"^[a-z][a-z0-9+.-]*://", "//")
    clean = F.regexp_replace(clean, r"^(//)?[^/@\s]*@", "//")
    clean = F.when(clean.startswith("//"), F.regexp_replace(clean, r"^//[^/:]+(?::\d+/+|[:/]+|$)", "")).otherwise(F.regexp_replace(clean, r"^(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+/+(?=[^/]+/+[^/]+)", ""))
    clean = F.regexp_replace(clean, r"/(?:tree|blob|raw|-)/.*$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^[/\s]+|[/\s]+$", ""), r"\.git$", "")
    clean = F.regexp_replace(clean, r"\s*/+\s*", "/")
    return F.when(clean != "", F.regexp_extract(clean, r"(?:[^/]+/)?[^/]+$", 0))


def owner(repo: Column) -> Column:
    """The segment before the repository's own name; for a bare name, the name itself, marked."""
    return F.when(repo.contains("/"), F.regexp_extract(repo, r"^([^/]+)/", 1)).when(repo.isNotNull(), F.concat(F.lit("/"), repo))


def path_head(path: Column) -> Column:
    """``owner/name`` as the first two of at least three segments of a path, in lower case."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(path, BLANK, ""), r"^(?:\./|/)+", ""))
    head = F.regexp_extract(clean, r"^([^/]+/[^/]+)/+[^/]", 1)
    return F.when(head != "", head)


def hash_to_min(pairs: DataFrame, max_rounds: int = 60, hot: int = 100_000) -> DataFrame:
    """Components of an undirected graph given as rows (a, b): rows (node, component), the component being its smallest node.

    Nulls are ignored; self-loops give components of one node. Runs until stable; ``max_rounds`` guards against a bug and raises.
    """
    ends = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = ends.union(ends.select("b", "a"))
    clusters = cut_lineage(both.union(both.select("a", "a")).toDF("node", "member").distinct())
    state = _fingerprint(clusters)
    for _ in range(max_rounds):
        least = clusters.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n"))
        # The smallest node of a large component has a row per member: above ``hot`` rows they meet their minimum through a salted key.
        told = salted_join(clusters, least.select("node", "least"), ["node"], "member", least, total=state[0], least=hot).select("least", "member")
        up, down = F.struct(F.col("least").alias("node"), F.col("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member"))
        fresh = cut_lineage(told.select(F.explode(F.array(up, down)).alias("p")).select("p.node", "p.member").distinct())
        after = _fingerprint(fresh)
        clusters = fresh
        if after == state:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        state = after
    raise RuntimeError("components did not settle")


def _fingerprint(clusters: DataFrame) -> tuple:
    return tuple(clusters.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(20,0)"))).first())


def owners_of_rows(code: DataFrame) -> DataFrame:
    """One row per input row: file_id, one and other (its owners, null if none), the stored names."""
    rows = code.select(
        "file_id", F.col("max_stars_repo_name").alias("first_name"), F.col("repo_name").alias("second_name"),
        repository(F.col("max_stars_repo_name")).alias("first_repo"), repository(F.col("repo_name")).alias("second_repo"), path_head(F.col("max_stars_repo_path")).alias("head"),
    )
    rows = cut_lineage(rows)
    nameless = F.col("first_repo").isNull() & F.col("second_repo").isNull()
    named = rows.where(~nameless).select("file_id", F.coalesce(owner(F.col("first_repo")), owner(F.col("second_repo"))).alias("one"), F.coalesce(owner(F.col("second_repo")), owner(F.col("first_repo"))).alias("other"), "first_name", "second_name")
    lone = rows.where(nameless).select("file_id", "head")
    heads = lone.where(F.col("head").isNotNull()).groupBy("head").agg(F.count("*").alias("n"))
    repos = rows.where(~nameless).select(F.explode(F.array("first_repo", "second_repo")).alias("head")).where(F.col("head").contains("/")).join(heads, "head", "left_semi").distinct()
    known = repos.withColumn("found", owner(F.col("head")))
    placed = salted_join(lone, known, ["head"], "file_id", heads, how="left").select("file_id", F.col("found").alias("one"), F.col("found").alias("other"), F.lit(None).cast("string").alias("first_name"), F.lit(None).cast("string").alias("second_name"))
    return named.unionByName(placed)


def grouped_rows(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (file_id, node, component) and groups (component, n_rows, group_name).

    Groups are summed from totals per owner, so no task meets all rows of a group. Only owners tied to others are
    looked up in the components; rows reach their component through a key that is salted for hot owners and null ones.
    """
    rows = cut_lineage(owners_of_rows(code))
    ties = rows.where("one <> other").select(F.col("one").alias("a"), F.col("other").alias("b")).distinct()
    components = cut_lineage(hash_to_min(ties))
    name = lambda c: F.when(F.regexp_replace(c, BLANK, "") != "", F.col(c))
    least = F.least(name("first_name"), name("second_name"))
    owners = cut_lineage(rows.where(F.col("one").isNotNull()).groupBy(F.col("one").alias("node")).agg(F.count("*").alias("n"), F.min(least).alias("least")))
    settled = owners.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = settled.groupBy("component").agg(F.sum("n").alias("n_rows"), F.min("least").alias("group_name"))
    members = salted_join(rows.select("file_id", F.col("one").alias("node")), components, ["node"], "file_id", owners, how="left").select("file_id", "node", F.coalesce("component", "node").alias("component"))
    return members, groups


def found_groups(code: DataFrame) -> DataFrame:
    """(group_name, file_id) of every row in a group of at least two rows."""
    members, groups = grouped_rows(code)
    groups = cut_lineage(groups.where("n_rows >= 2"))
    return salted_join(members.where(F.col("component").isNotNull()), groups.select("component", "group_name"), ["component"], "file_id", groups, n="n_rows").select("group_name", "file_id")


def rendezvous(key: Column, weights: dict[str, float], salt: str = "split-v1") -> Column:
    """The split of a key: the name with the smallest -ln(u)/weight, u from a hash of salt, name and key."""
    if not weights or any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must be non-negative, one positive")
    draws = []
    for name in sorted(weights):
        if weights[name] > 0:
            bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}\n{name}\n"), key), 256), 1, 13), 16, 10).cast("double")
            draws.append(F.struct((-F.log((bits + 0.5) / F.lit(float(16**13))) / F.lit(float(weights[name]))).alias("draw"), F.lit(name).alias("split")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["split"]


def assign_splits(code: DataFrame, weights: dict[str, float] | None = None, salt: str = "split-v1") -> DataFrame:
    """(file_id, split) for every row; all rows of a component share one split."""
    weights = weights or {"train": 0.9, "validation": 0.05, "test": 0.05}
    members, _ = grouped_rows(code)
    key = F.coalesce(F.concat(F.lit("owner="), F.col("component")), F.concat(F.lit("file="), F.col("file_id").cast("string")), F.lit("none"))
    return members.select("file_id", rendezvous(key, weights, salt).alias("split"))
