"""Operator 6. Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find, one line kept per component.

A line is a piece of a text between line feeds; lines are compared stripped and in lower case, by their distinct 5-character shingles (a
shorter line is one shingle). Lines are known by a 64-bit hash, so equal ones are one. Signatures have 80 minima in 16 bands of 5: a pair of similarity 0.8 meets
in a band with probability 0.998, one of 0.82 with 0.9994, one of 0.85 with 0.9999. Links are confirmed on the whole shingle sets. Of a component the occurrence
with the least (doc_id, hash of the text, line number) stays; the others leave their documents.

Defined cases: blank lines are no lines to compare and stay; a null text stays null; an empty one stays empty; a document may lose all its
lines and then has an empty text; rows with a null doc_id come first in order; rows repeated in full are one occurrence and keep the same
lines; further columns stay; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import RANDOM_KEYS, arrow_map, column, cut, distinct, forget, fresh, lookup, mixed, of_groups, seeded
from folioflow.llm.components import linked_components

WIDTH, ROWS, BANDS = 5, 5, 16
#: Codes of a line in a column of the table that minima are taken of.
TALL = 16
SIMILARITY = (80, 100)
_MUL = seeded(61, WIDTH) | np.uint64(1)
_A = (seeded(62, ROWS * BANDS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TAGS = (np.arange(ROWS * BANDS, dtype=np.uint64) << np.uint64(32))[:, None]


def normal(line: str) -> str:
    return line.strip().lower()


def node_of(line: str) -> int:
    """A line's 64-bit hash, by which it is known."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _gram_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = max(1, len(c) - WIDTH + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WIDTH, len(c))):
            total += (c[k : k + n] + np.uint64(1)) * _MUL[k]
    return total


def line_set(line: str) -> np.ndarray:
    """Sorted distinct codes of the shingles of a normal line."""
    return distinct(_gram_codes(line))


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each line (one row each) and a bit of each of its minima (two numbers), for many lines at once."""
    keys = np.empty((len(lines), BANDS), np.int64)
    bits = np.zeros((len(lines), 128), np.uint8)
    start = 0
    while start < len(lines):
        end, held = start, 0
        while end < len(lines) and (end == start or held + len(lines[end]) <= 60_000):
            held += len(lines[end])
            end += 1
        some = lines[start:end]
        # each line is filled up to one shingle at least; shingles over the end of a line are left out
        padded = np.maximum(np.array([len(x) for x in some]), WIDTH)
        codes = _gram_codes("".join(x if len(x) >= WIDTH else x + "\0" * (WIDTH - len(x)) for x in some))
        ends = np.cumsum(padded)
        keep = np.ones(int(ends[-1]), bool)
        for k in range(1, WIDTH):
            keep[ends - k] = False
        codes = mixed(codes[keep[: len(codes)]])
        low = (codes >> np.uint64(32)).astype(np.uint32) ^ codes.astype(np.uint32)
        # each line's codes fill whole columns of a table, its last one as often as it takes: minima go along the rows, then over few columns
        counts = padded - WIDTH + 1
        starts, tall = np.cumsum(counts) - counts, -(-counts // TALL)
        firsts = np.cumsum(tall) - tall
        of = np.repeat(np.arange(len(some)), tall)
        place = (np.arange(len(of)) - firsts[of])[None, :] * TALL + np.arange(TALL)[:, None]
        filled = low[starts[of] + np.minimum(place, counts[of] - 1)]
        least, product = np.empty((ROWS * BANDS, len(some)), np.uint64), np.empty_like(filled)
        with np.errstate(over="ignore"):
            for r, a in enumerate(_A):
                np.multiply(filled, a, out=product)
                least[r] = np.minimum.reduceat(product.min(axis=0), firsts)
            least = mixed(least + _TAGS)
            bits[start:end, : ROWS * BANDS] = (least & np.uint64(1)).T
            keys[start:end] = mixed(least.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64)).view(np.int64).T
        start = end
    return keys, np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """node, doc_id, th, line_no of each line that isn't blank; with keys and bits where a slice of the input has the line first."""

    def f(part: pa.RecordBatch) -> dict:
        ids, ths, nos, nodes, texts, first, seen = [], [], [], [], [], [], {}
        for doc_id, th, text in zip(column(part, "doc_id"), column(part, "th"), column(part, "text"), strict=True):
            for no, raw in enumerate((text or "").split("\n")):
                if line := normal(raw):
                    node = seen.get(line)
                    if node is None:
                        node = seen[line] = node_of(line)
                        first.append(len(nodes))
                        texts.append(line)
                    ids.append(doc_id)
                    ths.append(th)
                    nos.append(no)
                    nodes.append(node)
        keys, bits = band_keys(texts)
        new = np.zeros(len(nodes), bool)
        new[first] = True
        offsets = pa.array(np.concatenate([[0], np.cumsum(new * BANDS)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))
        wide = np.zeros((len(nodes), 2), np.int64)
        wide[first] = bits
        return {"node": nodes, "doc_id": ids, "th": ths, "line_no": nos, "keys": lists, "b0": wide[:, 0], "b1": wide[:, 1]}

    return cut(arrow_map(_keyed(docs), f, "node long, doc_id long, th long, line_no int, keys array<long>, b0 long, b1 long", []), **RANDOM_KEYS)


def _fetcher(docs: DataFrame, where: DataFrame):
    """Texts of lines, from one occurrence each."""

    def f(part: pa.RecordBatch) -> dict:
        nodes, texts = [], []
        for text, wanted in zip(column(part, "text"), column(part, "wanted"), strict=True):
            lines = text.split("\n")
            for w in wanted:
                nodes.append(w["node"])
                texts.append(normal(lines[w["line_no"]]))
        return {"node": nodes, "line": texts}

    def fetch(nodes: DataFrame) -> DataFrame:
        at = nodes.join(where, "node").groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th")).agg(F.collect_list(F.struct("node", "at.line_no")).alias("wanted"))
        at = cut(at)
        n, cells = at.agg(F.count(F.lit(1)), F.sum(F.size("wanted"))).first()
        # a row that is repeated in full gives its lines again
        rows = _keyed(docs).join(lookup(at, n, 3 * (cells or 0)), (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
        found = cut(arrow_map(rows.select("text", "wanted"), f, "node long, line string", []).select("node", F.col("line").alias("text")))
        forget(at)
        return found if found.count() == (cells or 0) else found.dropDuplicates(["node"])

    return fetch


def duplicate_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The lines that have to go: doc_id, th (hash of the text) and the sorted numbers of its lines, one row for each such document; cut."""
    all_ = _occurrences(docs)
    nodes = all_.where("size(keys) > 0").select("node", "keys", "b0", "b1")
    where = cut(all_.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "line_no")).alias("at")))
    roots = linked_components(nodes, _fetcher(docs, where), similarity, ROWS * BANDS, line_set)
    rooted = where.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    linked = cut(rooted.where("root is not null").select("node", "root", "at"))
    firsts = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("stays"))
    # a line without links that occurs once is nothing to look for
    alone = rooted.where("root is null and c > 1").select("node", F.col("at").alias("stays"))
    known = cut(of_groups(linked.select("node", "root"), "root", firsts).select("node", "stays").union(alone).withColumnRenamed("node", "d"))
    go = all_.select("node", "doc_id", "th", "line_no").join(lookup(known, known.count()), F.col("node") == F.col("d")).where(~F.struct("doc_id", "th", "line_no").eqNullSafe(F.col("stays")))
    out = cut(go.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("lines")))
    forget(all_, where, linked, known)
    return out


def without_duplicate_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, total: str = "n_lines", gone: str = "n_removed") -> DataFrame:
    """docs with their remaining lines, how many lines each had (one for an empty text, null for a null one) and how many it lost."""
    go = duplicate_lines(docs, similarity)
    n, cells = go.agg(F.count(F.lit(1)), F.sum(F.size("lines"))).first()
    key, g_id, g_th, drop = fresh([*docs.columns, total, gone], "key", "g_id", "g_th", "drop")
    go = lookup(go, n, cells or 0).toDF(g_id, g_th, drop)
    joined = docs.withColumn(key, F.xxhash64("text")).join(go, (F.col(key) == F.col(g_th)) & F.col("doc_id").eqNullSafe(F.col(g_id)), "left")
    rest = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, k: ~F.array_contains(F.col(drop), k)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(rest)
    lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias(total)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], lines, F.coalesce(F.size(drop), F.lit(0)).alias(gone))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the text left, and how many lines it had (a null text: none) and lost."""
    out = without_duplicate_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_removed")
