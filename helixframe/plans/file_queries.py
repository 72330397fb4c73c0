"""Registered queries that write derived tables as files or stores and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.embedding import HashedTrigrams
from helixframe.operators.evidence import evidence
from helixframe.plans.assistant import Assistant
from helixframe.plans.ingest import Ingestion
from helixframe.plans.queries import ARTICLES_SQL, CLINICAL, FOCUS, LINES_SQL, TARGET, VIEWS_SQL, _annotations, _articles, _clinical, _lines, _table, _variants, _vectors, benchmark_variants
from helixframe.schemas import ANNOTATIONS, EVIDENCE, ID_LIST, PROFILES, SUMMARIES, VECTORS
from helixframe.sources.annotations import first_existing, read_annotations, write_annotations
from helixframe.sources.bgzf import read_bgzf, write_bgzf
from helixframe.sources.literature import articles, embedded, read_responses, read_vectors
from helixframe.sources.order import bgzf_in_file_order
from helixframe.sources.store import Store, fresh_path
from helixframe.sources.versions import VersionedStore, VersionedTable
from helixframe.sources.vcf import HEADER, SAMPLE, info, numbered_lines, parse_lines, read_lines, read_vcf, record_line, write_vcf

SHOWN = ", ".join(EVIDENCE.names)
EMBEDDED, QUESTION = 32, "muscle toxicity and statin side effects"
BLOCK_SPLIT = 64 << 10  # small, so that the small tables' files are cut too


def _written_lines(spark: SparkSession, sf_dir: str, compression: str) -> str:
    path = fresh_path(spark, "lines")
    _lines(spark, sf_dir).select("value").write.option("lineSep", "\n").option("compression", compression).text(path)
    return path


def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path that exists, its lines as they are."""
    path = _written_lines(spark, sf_dir, "none")
    return read_lines(spark, first_existing(spark, [path + "-none", path, path + "-other"]))


def scan_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed lines, parsed."""
    return read_vcf(spark, f"{_written_lines(spark, sf_dir, 'gzip')}/*.gz")


def scan_bgzf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files of compressed blocks, each cut over many tasks, parsed."""
    path = fresh_path(spark, "blocks")
    write_bgzf(_lines(spark, sf_dir).select("value"), path)
    return parse_lines(read_bgzf(spark, path, BLOCK_SPLIT), "value")


def evidence_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of evidence in the order of a variant file's lines, then of an annotation file's records."""
    path, notes = fresh_path(spark, "blocks"), fresh_path(spark, "annotations")
    in_order = lambda df, key: df.repartitionByRange(8, key).sortWithinPartitions(key)
    write_bgzf(in_order(_variants(spark, sf_dir), "ord").select(record_line().alias("value")), path)
    write_annotations(in_order(_annotations(spark, sf_dir), "c_ord"), notes)
    lines = bgzf_in_file_order(read_bgzf(spark, path, BLOCK_SPLIT))
    return evidence(parse_lines(lines, keep=["line"]), read_annotations(spark, notes, number="record"), TARGET, "served", order=("line", "record"))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of plain files with its number."""
    path = fresh_path(spark, "lines")
    _lines(spark, sf_dir).repartitionByRange(8, "ord").sortWithinPartitions("ord").select("value").write.option("lineSep", "\n").text(path)
    return numbered_lines(spark, path)


def article_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each article's title and abstract, its elements to six digits."""
    rows = embedded(_articles(spark, sf_dir).select("pmid", "title", "abstract"), HashedTrigrams(EMBEDDED))
    return rows.select("pmid", F.posexplode("vector").alias("place", "x")).select("pmid", "place", F.round("x", 6).alias("x"))


def articles_to_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles embedded, kept as vectors of a known dimension, a part of them merged in again, and the nearest to a question with all they have."""
    embed, store = HashedTrigrams(EMBEDDED), VersionedStore(spark, fresh_path(spark, "store"))
    store.create_vectors(EMBEDDED)
    docs = embedded(_articles(spark, sf_dir), embed).select(F.col("pmid").alias("id"), F.col("pmid").cast("string").alias("pmid"), "title", "abstract", "year", "gene", "vector")
    store.upsert_vectors(docs.withColumn("year", F.when(F.col("id") % 10 == 3, "1900").otherwise(F.col("year"))), "articles:0")
    for _ in range(2):  # the second is the same batch again
        store.upsert_vectors(docs.where("id % 10 = 3").withColumn("title", F.concat(F.lit("Again: "), "title")), "articles:1")
    hits = Assistant(spark, store, store.vectors(), lambda text: embed([text])[0]).search_literature(QUESTION, 5)
    return hits.select("id", "pmid", "title", "year", "gene", "abstract", F.round("score", 6).alias("score"))


def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, T4: a table in buckets after two appends of one batch, and a merge of another, twice."""
    now = _vectors(spark, sf_dir).select("id", F.col("label").cast("bigint").alias("label"))
    batch = now.where("id % 3 = 0").select("id", (F.col("label") + 100).alias("label")).unionByName(now.where("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), "label"))
    table = VersionedTable.create(spark, fresh_path(spark, "versions"), now.schema, ("id",), 16)
    for _ in range(2):
        table.append(now, "load:0")
    for _ in range(2):
        table.upsert(batch, "load:1")
    return table.read()


def ingest_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of compressed blocks ingested twice under one name; its records, and the lines counted as they were written."""
    path, store = fresh_path(spark, "blocks"), VersionedStore(spark, fresh_path(spark, "store"))
    write_bgzf(_lines(spark, sf_dir).select("value"), path)
    runs = [Ingestion(spark, store), Ingestion(spark, store)]
    for run in runs:
        run.run("u", path, mode="append", batch="file")
    done = next(p for p in runs[0].history if p.total is not None)
    return store.variants("u").groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("positions")).select("*", F.lit(done.done).cast("bigint").alias("lines"), F.lit(done.text).alias("shown"))


def _annotation_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "annotations")
    write_annotations(_annotations(spark, sf_dir), path)
    return path


def annotations_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, K9."""
    return read_annotations(spark, _annotation_file(spark, sf_dir))


def annotations_tsv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is the empty text."""
    return read_annotations(spark, _annotation_file(spark, sf_dir), raw=True)


def store_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by user after writes of each mode."""
    store, v = Store(spark, fresh_path(spark, "store")), _variants(spark, sf_dir)
    even = v.where("ord % 2 = 0")
    writes = (("fresh", v, "if_empty"), ("kept", v, "overwrite"), ("kept", even, "if_empty"), ("appended", v, "overwrite"), ("appended", even, "append"), ("replaced", v, "overwrite"), ("replaced", even, "overwrite"))
    for user, rows, mode in writes:
        store.write_variants(rows, user, mode)
    users = ("fresh", "kept", "appended", "replaced", "nobody")
    found = [store.variants(u).agg(F.lit(u).alias("user_id"), F.count("*").alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positions")) for u in users]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def evidence_other_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store's variants with the annotations of another, which has those of large parts."""
    store, other = Store(spark, fresh_path(spark, "store")), fresh_path(spark, "reference")
    store.write_variants(_variants(spark, sf_dir), "a")
    store.write_annotations(_annotations(spark, sf_dir))
    large = _table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("c_ord"))
    Store(spark, other).write_annotations(_annotations(spark, sf_dir).join(large, "c_ord", "left_semi"))
    return evidence(store.variants("a"), store.annotations(other), TARGET, "strict")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    name = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    return v.select("id", name("p").alias("pmid"), name("title \"").alias("title"), name("about ").alias("abstract"), F.lit("2025").alias("year"), name("G").alias("gene"), F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


def vectors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector documents as JSON."""
    path = fresh_path(spark, "vectors")
    _documents(spark, sf_dir).write.json(path)
    return read_vectors(spark, path).select(*VECTORS.names[:-1], F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def vectors_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K7: the second write of vectors replaces the first."""
    store, rows = Store(spark, fresh_path(spark, "store")), _documents(spark, sf_dir)
    size = rows.select(F.size("vector")).first()[0]
    store.write_vectors(rows, size)
    store.write_vectors(rows.where("id % 2 = 1"), size)
    return store.vectors().select("id", "title", F.size("vector").alias("n"))


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "responses")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("part")).distinct()
    gene = F.col("o").cast("string")
    ids = items.groupBy("o").agg(F.sort_array(F.collect_list("part")).alias("idlist")).select(F.col("o"), F.to_json(F.struct(gene.alias("gene"), F.struct("idlist").alias("esearchresult"))).alias("value"))
    ids.select(F.when(F.col("o") % 10 == 0, "<html>").otherwise(F.col("value"))).write.text(f"{path}/ids")
    entry = F.struct("part", F.struct(F.when(F.col("o") % 3 > 0, F.concat(F.lit("Part "), "part")).alias("title"), F.when(F.col("o") % 4 > 0, "1999 Jan").alias("pubdate"), F.lit("").alias("source")))
    some = items.where("cast(part as int) % 2 = 1").groupBy("o").agg(F.map_from_entries(F.collect_list(entry)).alias("result"))
    some.select(F.to_json(F.struct(gene.alias("gene"), "result"))).write.text(f"{path}/summaries")
    return path


def articles_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches that aren't JSON, counted by what they are."""
    return read_responses(spark, f"{_recorded(spark, sf_dir)}/ids", ID_LIST, bad=True).groupBy("bad").agg(F.count("*").alias("n"))


def articles_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded searches and summaries; every tenth order's search isn't JSON and is left out."""
    path = _recorded(spark, sf_dir)
    found = articles(read_responses(spark, f"{path}/ids", ID_LIST).select("gene", "esearchresult.idlist"), read_responses(spark, f"{path}/summaries", SUMMARIES), 3)
    return found.withColumn("ord", F.col("ord").cast("bigint"))


def benchmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clinical table and background variants as a variant file, line by line."""
    path = fresh_path(spark, "benchmark")
    known = _clinical(spark).withColumn("line", record_line(info(F.col("rsid"), F.col("gene"), F.col("clinical_significance")), "99.9"))
    chrom = F.concat(F.lit("GENE_"), F.replace("chrom", F.lit("chr"), F.lit("")))
    other = benchmark_variants(spark, sf_dir).withColumn("line", record_line(info(F.col("rsid"), chrom), "98.5", "85:40"))
    columns = ["chrom", "pos", "rsid", "line"]
    write_vcf(known.select(columns).unionByName(other.select(columns)), path, line=F.col("line"))
    return read_lines(spark, path)


def benchmark_file_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's variants with the clinical table's annotations from a stored copy."""
    path, store = fresh_path(spark, "benchmark"), Store(spark, fresh_path(spark, "store"))
    columns = ["chrom", "pos", "rsid", "ref", "alt", "gt_raw"]
    write_vcf(_clinical(spark).select(columns).unionByName(benchmark_variants(spark, sf_dir).select(columns)), path)
    store.write_annotations(_clinical(spark).select(ANNOTATIONS.names))
    return evidence(read_vcf(spark, path), store.annotations(), None, "served").select(EVIDENCE.names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (article_embeddings, articles_to_hits, versioned_upsert, ingest_committed, scan_text, scan_gzip, scan_bgzf, evidence_line_order, line_numbers, annotations_tsv, annotations_tsv_raw, store_modes, evidence_other_root, vectors_json, vectors_overwritten, articles_recorded, articles_rejected, benchmark_file, benchmark_file_evidence)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    columns = "rsid, gene, phenotype, clinical_significance, evidence_note"
    texts = lambda row: "(" + ", ".join(repr(x) for x in row) + ")"
    clinical = "known(chrom, pos, rsid, ref, alt, gt_raw, gene, phenotype, clinical_significance, evidence_note) AS (VALUES " + ", ".join(map(texts, CLINICAL)) + ")"
    background = "background AS (SELECT 'chr' || ((c_custkey + 1) % 22 + 1) AS chrom, (c_custkey + 1) * 14250 + 1000000 AS pos, 'rs10000' || (c_custkey + 1) AS rsid, ['A', 'C', 'G', 'T'][(c_custkey + 1) % 4 + 1] AS ref, ['A', 'C', 'G', 'T'][(c_custkey + 2) % 4 + 1] AS alt, ['0/0', '0/1', '1/1'][(c_custkey + 1) % 3 + 1] AS gt_raw FROM customer)"
    header = ", ".join(f"({line!r})" for line in HEADER)
    fields = "concat_ws(chr(9), chrom, pos, rsid, ref, alt, {}, 'PASS', {}, 'GT:GQ:DP', gt_raw || {})"
    served = "CASE WHEN gt_raw = '0/0' THEN ref || '/' || ref WHEN gt_raw = '0/1' THEN ref || '/' || alt ELSE alt || '/' || alt END"
    title = "CASE WHEN o % 3 > 0 THEN 'Part ' || part ELSE 'Untitled Article' END"
    year = "CASE WHEN o % 4 > 0 THEN '1999' ELSE '2025' END"
    abstract = f"title || '. Published in ' || source || ' (' || year || '). Clinical focus on ' || gene || '{FOCUS}'"
    grams = "unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
    placed = f"placed AS (SELECT pmid, h // 2 % {EMBEDDED} AS place, 1 - 2 * (h % 2) AS sign FROM (SELECT pmid, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (SELECT pmid, {grams} AS g FROM texts))), summed AS (SELECT pmid, place, sum(sign)::DOUBLE AS s FROM placed GROUP BY ALL), sized AS (SELECT pmid, sqrt(sum(s * s)) AS size FROM summed GROUP BY pmid)"
    embeddings = f"{ARTICLES_SQL}, texts AS (SELECT pmid, ' ' || title || ' ' || {abstract} || ' ' AS t FROM base), {placed}"
    question = f"{embeddings.replace(' FROM base), placed', f' FROM base UNION ALL SELECT -1, {chr(39)} {QUESTION} {chr(39)}), placed')}, scored AS (SELECT a.pmid, sum(a.s * q.s) AS dot FROM summed a JOIN summed q ON q.pmid = -1 AND a.place = q.place WHERE a.pmid >= 0 GROUP BY a.pmid)"
    return {
        "article_embeddings": f"{embeddings} SELECT b.pmid, p.place::INT AS place, CASE WHEN z.size > 0 THEN round(coalesce(s, 0) / z.size, 6) ELSE 0 END AS x FROM base b CROSS JOIN (SELECT unnest(range({EMBEDDED})) AS place) p JOIN sized z ON z.pmid = b.pmid LEFT JOIN summed m ON m.pmid = b.pmid AND m.place = p.place",
        "articles_to_hits": f"{question} SELECT b.pmid AS id, b.pmid::VARCHAR AS pmid, CASE WHEN b.pmid % 10 = 3 THEN 'Again: ' ELSE '' END || title AS title, year, gene, {abstract} AS abstract, round(coalesce(dot, 0) / (z.size * o.size), 6) AS score FROM base b JOIN sized z ON z.pmid = b.pmid JOIN sized o ON o.pmid = -1 LEFT JOIN scored c ON c.pmid = b.pmid ORDER BY coalesce(dot, 0) / (z.size * o.size) DESC, b.pmid LIMIT 5",
        "versioned_upsert": "SELECT vec_id AS id, label::BIGINT + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label::BIGINT FROM embeddings WHERE vec_id % 5 = 0",
        "ingest_committed": LINES_SQL + "SELECT p[1] AS chrom, count(*) AS n, sum(n)::BIGINT AS positions, (SELECT count(*) FROM lines) AS lines, '100.0%' AS shown FROM judged WHERE reject IS NULL GROUP BY 1",
        "scan_text": LINES_SQL + "SELECT value FROM lines",
        "scan_gzip": LINES_SQL + "SELECT p[1] AS chrom, n AS pos, p[3] AS rsid, p[4] AS ref, p[5] AS alt, gt AS gt_raw FROM judged WHERE reject IS NULL",
        "scan_bgzf": LINES_SQL + "SELECT p[1] AS chrom, n AS pos, p[3] AS rsid, p[4] AS ref, p[5] AS alt, gt AS gt_raw FROM judged WHERE reject IS NULL",
        "evidence_line_order": VIEWS_SQL + f"SELECT {SHOWN} FROM shown WHERE (gene = '{TARGET}' OR rsid = '{TARGET}') AND clinical_significance IN {PROFILES['served'].significance} ORDER BY ord, c_ord LIMIT 10",
        "line_numbers": LINES_SQL + "SELECT value, row_number() OVER (ORDER BY ord) - 1 AS line FROM lines",
        "annotations_tsv": VIEWS_SQL + f"SELECT {columns} FROM annotations",
        "annotations_tsv_raw": VIEWS_SQL + f"SELECT {columns.replace('clinical_significance', 'coalesce(clinical_significance, chr(0)) AS clinical_significance').replace('chr(0)', repr(''))} FROM annotations",
        "store_modes": VIEWS_SQL + ", u AS (SELECT unnest(['fresh', 'kept', 'appended', 'replaced', 'nobody']) AS user_id), s AS (SELECT count(*) AS n, sum(pos)::BIGINT AS p, count(*) FILTER (ord % 2 = 0) AS ne, (sum(pos) FILTER (ord % 2 = 0))::BIGINT AS pe FROM variants) SELECT user_id, CASE user_id WHEN 'appended' THEN n + ne WHEN 'replaced' THEN ne WHEN 'nobody' THEN 0 ELSE n END AS n, CASE user_id WHEN 'appended' THEN p + pe WHEN 'replaced' THEN pe WHEN 'nobody' THEN 0 ELSE p END AS positions FROM u, s",
        "evidence_other_root": VIEWS_SQL + f"SELECT rsid, gene, user_genotype, phenotype, clinical_significance, evidence_note FROM shown JOIN part ON c_ord = p_partkey WHERE (gene = '{TARGET}' OR rsid = '{TARGET}') AND clinical_significance IN ('Pathogenic', 'Likely Pathogenic', 'Risk Factor') AND p_size > 25",
        "vectors_json": "SELECT vec_id AS id, 'p' || vec_id AS pmid, 'title \"' || vec_id AS title, 'about ' || vec_id AS abstract, '2025' AS year, 'G' || vec_id AS gene, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 4))), 4) AS total FROM embeddings",
        "vectors_overwritten": "SELECT vec_id AS id, 'title \"' || vec_id AS title, len(embedding)::INT AS n FROM embeddings WHERE vec_id % 2 = 1",
        "articles_rejected": "SELECT '<html>' AS bad, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 10 = 0",
        "articles_recorded": f"WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey::VARCHAR AS part FROM lineitem WHERE l_orderkey % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY part) - 1 AS ord FROM i) SELECT o::VARCHAR AS gene, part AS pmid, ord, {title} AS title, {year} AS year, {title} || '. Published in Medical Journal (' || {year} || '). Clinical focus on ' || o || '{FOCUS}' AS abstract FROM r WHERE ord < 3 AND part::INT % 2 = 1",
        "benchmark_file": f"WITH {clinical}, {background} SELECT {fields.format(repr('99.9'), "'RS=' || rsid || ';GENE=' || gene || ';CLNSIG=' || regexp_replace(clinical_significance, '[[:space:]]+', '_', 'g')", repr(':99:65'))} AS value FROM known UNION ALL SELECT {fields.format(repr('98.5'), "'RS=' || rsid || ';GENE=GENE_' || substr(chrom, 4)", repr(':85:40'))} FROM background UNION ALL SELECT * FROM (VALUES {header}) UNION ALL SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', '{SAMPLE}')",
        "benchmark_file_evidence": f"WITH {clinical}, {background} SELECT v.rsid, gene, {served.replace('gt_raw', 'v.gt_raw').replace('ref', 'v.ref').replace('alt', 'v.alt')} AS user_genotype, phenotype, clinical_significance, evidence_note FROM (SELECT chrom, pos, rsid, ref, alt, gt_raw FROM known UNION ALL SELECT * FROM background) v JOIN known k ON v.rsid = k.rsid WHERE clinical_significance IN ('Pathogenic', 'Likely Pathogenic', 'Risk Factor', 'Drug Response') ORDER BY ALL LIMIT 10",
    }
