"""Problem 2: exact token counts under a given byte-level BPE, rolled up by source, language and category.

Method: a document longer than ``oversize`` characters is cut into chunks only where the tokenizer provably cannot
join what lies on both sides; the chunks are salted across the workers, counted, and their exact counts summed per
document. The others are counted where they are read, without a shuffle of text. Both happen in one pass over the texts, whose
result (a number per document, and the chunks of the oversized ones) is written to the shared folder. Slices are rolled up from the
counts, with partial aggregation before the exchange.

Why the cuts are safe. Pre-tokens are matches of the pattern below, which scans from left to right. (1) No
alternative runs from a non-blank into white space, so a match ends at every such place. (2) A run of word
characters ends before a character that is neither word nor blank, and no alternative runs from the one into the
other. (3) Within a pre-token, merges only join adjacent symbols into a vocabulary piece; if no piece contains the
bytes x and y side by side, nothing that merges can ever span a place between x and y, and both sides merge alone.

Null texts count 0 tokens, as do empty ones. Null labels become ``unknown``. Repeated rows count as often as they
occur; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.subword import Subword, byte_chars
from corpusmill.session import cut_lineage, ship_by_value, spread, table

#: Fixed value: the pre-token pattern of the tokenizer artifact.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\w+| ?[^\s\w]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level BPE artifact: merges in rank order and the id of each piece. Its size is that of the vocabulary."""

    merges: tuple[tuple[str, str], ...]
    vocab: dict[str, int]

    @staticmethod
    def load(spark: SparkSession, directory: str, max_merges: int = 2_000_000) -> ByteBpe:
        """From the tables tokenizer_merges and tokenizer_vocab. A vocabulary is bounded; more than ``max_merges`` rows are an error."""
        merges = table(spark, directory, "tokenizer_merges").orderBy("merge_rank").limit(max_merges + 1).collect()
        if len(merges) > max_merges:
            raise ValueError(f"more than {max_merges} merges: this is no vocabulary to send to the workers")
        vocab = table(spark, directory, "tokenizer_vocab").limit(2 * max_merges + 1).collect()
        if len(vocab) > 2 * max_merges:
            raise ValueError(f"more than {2 * max_merges} pieces: this is no vocabulary to send to the workers")
        return ByteBpe(tuple((m["left_piece"], m["right_piece"]) for m in merges), {v["piece"]: v["token_id"] for v in vocab})


def mergeable_pairs(bpe: ByteBpe) -> set[tuple[str, str]]:
    """Byte characters that stand side by side in some piece a merge can make; all other neighbours are independent."""
    return {pair for left, right in bpe.merges for pair in zip(left + right, (left + right)[1:])}


def make_encoder(bpe: ByteBpe):
    """A function bytes of one pre-token -> its token strings: the best-ranked pair is merged until none is left."""
    alphabet = byte_chars()
    ranks = {pair: k for k, pair in reversed(list(enumerate(bpe.merges)))}
    return lambda data: Subword._merged([alphabet[b] for b in data], ranks)


def make_splitter(bpe: ByteBpe):
    """A function byte characters of one pre-token -> number of tokens: native where the library is there, else make_encoder."""
    try:
        from tokenizers import models
    except ImportError:
        code = {ch: b for b, ch in byte_chars().items()}
        encode = make_encoder(bpe)
        return lambda chars: len(encode(bytes(code[ch] for ch in chars)))
    pieces = dict.fromkeys([*byte_chars().values(), *(left + right for left, right in bpe.merges)])
    model = models.BPE(vocab={piece: k for k, piece in enumerate(pieces)}, merges=list(bpe.merges))
    return lambda chars: len(model.tokenize(chars))


class _Counts(dict):
    """Token counts by pre-token, filled on demand; emptied when it holds ``most`` of them."""

    def __init__(self, bpe: ByteBpe, most: int):
        super().__init__()
        self.most, self.table = most, {b: ord(ch) for b, ch in byte_chars().items()}
        self.split = make_splitter(bpe)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        hit = self[piece] = self.split(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table))
        return hit


def make_counter(bpe: ByteBpe, most: int = 300_000):
    """A function text -> number of tokens."""
    counts = _Counts(bpe, most)
    find = re.compile(PRETOKEN).findall
    get = counts.__getitem__

    def count(text: str) -> int:
        return sum(map(get, find(text)))

    return count


def make_cutter(bpe: ByteBpe, chunk: int):
    """A function text -> chunks of at least ``chunk`` characters that are tokenized independently of each other."""
    alphabet = byte_chars()
    pairs = mergeable_pairs(bpe)
    is_word = re.compile(r"\w").match

    def safe(text: str, k: int) -> bool:
        a, b = text[k - 1], text[k]
        if a.isspace():
            return False
        if b.isspace():
            return True
        if is_word(a) and not is_word(b):
            return True
        if bool(is_word(a)) != bool(is_word(b)) or b == "'" or "'" in text[max(0, k - 3) : k]:
            return False
        return (alphabet[a.encode("utf-8", "surrogatepass")[-1]], alphabet[b.encode("utf-8", "surrogatepass")[0]]) not in pairs

    def cut(text: str) -> list[str]:
        parts, start, k = [], 0, chunk
        while k < len(text):
            if safe(text, k):
                parts.append(text[start:k])
                start, k = k, k + chunk
            else:
                k += 1
        parts.append(text[start:])
        return parts

    return cut


def token_count_udf(bpe: ByteBpe):
    """Vectorised UDF text -> tokens (0 for null)."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make_counter(bpe)
        for texts in batches:
            yield pd.Series([0 if t is None else count(t) for t in texts], dtype="int64")

    ship_by_value()
    return F.pandas_udf(counted, "long")


def _counts_or_chunks(bpe: ByteBpe, oversize: int, chunk: int):
    """Vectorised UDF text -> (tokens, null) or, beyond ``oversize`` characters, (null, chunks)."""

    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count, cut = make_counter(bpe), make_cutter(bpe, chunk)
        for texts in batches:
            long = [t is not None and len(t) > oversize for t in texts]
            numbers = [None if big else count(t or "") for t, big in zip(texts, long)]
            yield pd.DataFrame({"n": pd.array(numbers, dtype="Int64"), "chunks": [cut(t) if big else None for t, big in zip(texts, long)]})

    ship_by_value()
    return F.pandas_udf(first, "n long, chunks array<string>")


def with_token_counts(df: DataFrame, text_col: str, bpe: ByteBpe, keep: list[str], oversize: int = 8_000, chunk: int = 4_000) -> DataFrame:
    """``keep`` columns and n_tokens for each row of ``df``; texts beyond ``oversize`` characters are spread in chunks."""
    rows = spread(df.select(*keep, F.col(f"`{text_col}`").alias("__text")))
    seen = rows.select(*keep, _counts_or_chunks(bpe, oversize, chunk)("__text").alias("__t"), F.monotonically_increasing_id().alias("__row"))
    seen = cut_lineage(seen.select(*keep, "__row", F.col("__t.n").alias("n_tokens"), F.col("__t.chunks").alias("__chunks")))
    small = seen.where(F.col("__chunks").isNull()).select(*keep, "n_tokens")
    names = [*keep, "__row"]
    chunks = seen.where(F.col("__chunks").isNotNull()).select(*names, F.posexplode("__chunks").alias("__at", "__part")).repartition(F.xxhash64("__row", "__at"))
    summed = chunks.select(*names, token_count_udf(bpe)("__part").alias("__n")).groupBy(*names).agg(F.sum("__n").alias("n_tokens")).select(*keep, "n_tokens")
    return small.unionByName(summed)


#: Other names of languages.
SYNONYMS = {
    "english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "spa": "es",
    "russian": "ru", "rus": "ru", "chinese": "zh", "zho": "zh", "chi": "zh", "py": "python", "python3": "python", "js": "javascript", "ecmascript": "javascript", "golang": "go", "c99": "c",
}


def uniform(label: Column) -> Column:
    """A label in lower case, without blanks around it; null and blank become ``unknown``."""
    clean = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.when(clean != "", clean), F.lit("unknown"))


def uniform_language(label: Column) -> Column:
    """A language label without region, its synonyms made one."""
    base = F.regexp_replace(uniform(label), r"^([a-z]{2,3})[-_][a-z0-9]+$", "$1")
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.element_at(names, base), base)


def token_budget(documents: DataFrame, code: DataFrame, catalog: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Rows and tokens by src_table, source, lang and category. The catalogue gives the category where a row has none."""
    kinds = catalog.select(uniform(F.col("dataset")).alias("source"), uniform(F.col("category")).alias("__kind")).dropDuplicates(["source"])
    doc_rows = with_token_counts(
        documents.select("text", uniform(F.col("source")).alias("source"), uniform(F.col("dataset")).alias("dataset"), uniform_language(F.col("lang")).alias("lang"), uniform(F.col("category")).alias("category")),
        "text", bpe, ["source", "dataset", "lang", "category"],
    )
    code_rows = with_token_counts(code.select("content", uniform(F.col("dataset")).alias("source"), uniform_language(F.col("lang")).alias("lang")), "content", bpe, ["source", "lang"])
    one = doc_rows.groupBy("source", "dataset", "lang", "category").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    one = one.join(kinds.withColumnRenamed("source", "dataset"), "dataset", "left").withColumn("category", F.when(F.col("category") != "unknown", F.col("category")).otherwise(F.coalesce("__kind", F.lit("unknown"))))
    two = code_rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).join(kinds, "source", "left").withColumn("category", F.coalesce("__kind", F.lit("unknown")))
    keys = ["src_table", "source", "lang", "category"]
    both = one.withColumn("src_table", F.lit("documents")).select(*keys, "n", "t").unionByName(two.withColumn("src_table", F.lit("code_files")).select(*keys, "n", "t"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("t").alias("n_tokens"))
