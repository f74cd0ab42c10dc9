"""Queries over presence relations: similarity, clusters, association, structure, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import stats as T
from ..operators import association, clustering, enrichment, graph, population
from ..operators import presence as P
from ..scratch import Scratch
from .adapters import ABUNDANT_SQL, WORDS_SQL, alignments, doc_word_sets, doc_words, h, table, word_count, word_hash
from .kmer_queries import abundant, joined
from .registry import query

NATION_PARTS = """np AS (SELECT DISTINCT n_name AS kmer, l_partkey AS sample_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ns AS (SELECT kmer, count(*)::DOUBLE AS m FROM np GROUP BY kmer), tot AS (SELECT count(*)::DOUBLE AS n FROM part),
sh AS (SELECT x.kmer AS a, y.kmer AS b, count(*)::DOUBLE AS s FROM np x JOIN np y ON x.sample_id = y.sample_id AND x.kmer < y.kmer GROUP BY x.kmer, y.kmer)"""


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a < b (nations), their numbers of parts, and the parts in common (at least one); from the nations' Gram matrix."""
    pairs = Scratch(spark).cut(population.gram(segment_presence(spark, sf_dir)))
    size = pairs.where("i = j").select("i", F.col("shared").cast("double").alias("size"))
    name = size.join(table(spark, sf_dir, "nation"), F.col("i") == F.col("n_nationkey")).select("i", F.struct(F.col("n_name").alias("name"), "size").alias("x"))
    met = pairs.where("i < j").join(name, "i").join(name.toDF("j", "y"), "j").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("shared").cast("double").alias("shared"))
    return met.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.size").alias("x"), F.col("y.size").alias("y"), "shared")


@query(f"WITH {NATION_PARTS} SELECT a, b, round(1 - s / (p.m + q.m - s), 10) AS dist FROM sh JOIN ns p ON p.kmer = a JOIN ns q ON q.kmer = b")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard distance of the part sets of nations."""
    return nation_pairs(spark, sf_dir).select("a", "b", F.round(A.jaccard_distance(F.col("shared"), F.col("x"), F.col("y")), 10).alias("dist"))


@query(f"WITH {NATION_PARTS} SELECT a, b, CASE WHEN n - s = 0 THEN 0 ELSE round(1 - 0.5::DOUBLE * (s / (p.m + q.m - s)) - 0.5::DOUBLE * ((n - (p.m + q.m - s)) / (n - s)), 10) END AS dist FROM sh JOIN ns p ON p.kmer = a JOIN ns q ON q.kmer = b, tot")
def jaccard_dual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the Jaccard distances of sets and complements."""
    n = float(table(spark, sf_dir, "part").count())
    return nation_pairs(spark, sf_dir).select("a", "b", F.round(A.dual_distance(F.col("shared"), F.col("x"), F.col("y"), F.lit(n)), 10).alias("dist"))


SKETCH_SQL = f"""{WORDS_SQL}, hashes AS (SELECT kmer, {h('sample_id')} AS hash FROM doc_words),
ranked AS (SELECT kmer, hash, row_number() OVER (PARTITION BY kmer ORDER BY hash) AS r FROM (SELECT DISTINCT kmer, hash FROM hashes)),
sketch AS (SELECT kmer, hash FROM ranked WHERE r <= 50),
cand AS (SELECT x.kmer AS a, y.kmer AS b, count(*)::BIGINT AS shared FROM sketch x JOIN sketch y ON x.hash = y.hash AND x.kmer < y.kmer GROUP BY x.kmer, y.kmer HAVING count(*) >= 37)"""
CLUSTER_SQL = f"""{SKETCH_SQL}, sizes AS (SELECT kmer, count(*)::DOUBLE AS m FROM doc_words GROUP BY kmer), tot AS (SELECT count(DISTINCT sample_id)::DOUBLE AS n FROM doc_words),
inter AS (SELECT c.a, c.b, count(*)::DOUBLE AS s FROM cand c JOIN doc_words x ON x.kmer = c.a JOIN doc_words y ON y.kmer = c.b AND y.sample_id = x.sample_id GROUP BY c.a, c.b),
edges AS (SELECT a, b FROM inter JOIN sizes p ON p.kmer = a JOIN sizes q ON q.kmer = b, tot WHERE 1 - 0.5::DOUBLE * (s / (p.m + q.m - s)) - 0.5::DOUBLE * ((n - (p.m + q.m - s)) / (n - s)) < 0.05),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(v, r) AS (SELECT kmer, kmer FROM sizes UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT v AS kmer, min(r) AS component FROM reach GROUP BY v)"""


def word_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sketches(doc_word_sets(spark, sf_dir), hasher=word_hash).drop("samples")


def word_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Clusters of the documents' word sets, the sets (made again by whoever reads them), and the number of words."""
    has, n, scratch = doc_word_sets(spark, sf_dir), word_count(spark, sf_dir), Scratch(spark)
    scratch.clean()
    return scratch.cut(clustering.cluster(has, n, hasher=word_hash)), has, n


@query(f"WITH {SKETCH_SQL} SELECT kmer, array_to_string(list_sort(list(hash)), ',') AS sketch FROM sketch GROUP BY kmer")
def minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty least word hashes of each document."""
    return word_sketches(spark, sf_dir).select("kmer", joined("sketch").alias("sketch"))


@query(f"WITH {SKETCH_SQL} SELECT a, b, shared FROM cand")
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share 37 of 50 hashes."""
    return clustering.candidates(word_sketches(spark, sf_dir))


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT kmer, component FROM comp")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents with near-identical words."""
    return word_clusters(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {CLUSTER_SQL}, mem AS (SELECT x.component, x.kmer AS a, y.kmer AS b FROM comp x JOIN comp y ON x.component = y.component AND x.kmer <> y.kmer),
mi AS (SELECT m.component, m.a, m.b, count(w.sample_id)::DOUBLE AS s FROM mem m JOIN doc_words v ON v.kmer = m.a LEFT JOIN doc_words w ON w.kmer = m.b AND w.sample_id = v.sample_id GROUP BY m.component, m.a, m.b),
md AS (SELECT component, a, 1 - 0.5::DOUBLE * (s / (p.m + q.m - s)) - 0.5::DOUBLE * ((n - (p.m + q.m - s)) / (n - s)) AS d FROM mi JOIN sizes p ON p.kmer = a JOIN sizes q ON q.kmer = b, tot),
rms AS (SELECT component, a, round(sqrt(sum(d * d) / count(*)), 12) AS rms FROM md GROUP BY component, a),
best AS (SELECT component, a, rms FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY rms, a) AS k FROM rms) WHERE k = 1)
SELECT c.component, c.size, coalesce(best.a, c.component) AS medoid, round(best.rms, 9) AS rms FROM (SELECT component, count(*)::BIGINT AS size FROM comp GROUP BY component) c LEFT JOIN best ON best.component = c.component""")
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and medoid of each cluster."""
    clusters, has, n = word_clusters(spark, sf_dir)
    return clustering.medoids(clusters, has, n).withColumn("rms", F.round("rms", 9))


@query(f"""WITH RECURSIVE {CLUSTER_SQL}, s AS (SELECT count(*)::BIGINT AS size FROM comp GROUP BY component), r AS (SELECT size, row_number() OVER (ORDER BY size DESC) - 1 AS place, count(*) OVER () AS m FROM s)
SELECT i::INT AS tile, size FROM r, LATERAL unnest(range(0, 21)) AS t(i) WHERE place = floor(i * (m - 1) / 20.0 + 0.5)""")
def component_size_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twentieths of the cluster sizes, from the largest."""
    return clustering.size_quantiles(word_clusters(spark, sf_dir)[0])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.05),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), v AS (SELECT a FROM sym UNION SELECT s_suppkey FROM supplier),
reach(v, r) AS (SELECT a, a FROM v UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT v AS vertex, min(r) AS component FROM reach GROUP BY v""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the slice of suppliers and parts that the recursive SQL selects; supplier_part_components has all."""
    return _supplier_parts(spark, sf_dir, table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount = 0.05"))


def _supplier_parts(spark: SparkSession, sf_dir: str, items: DataFrame, above: int = 1000000) -> DataFrame:
    """Components of a bipartite graph of suppliers and parts (numbered from `above`); single suppliers included."""
    edges = items.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + F.lit(above)).alias("b")).distinct()
    vertices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v")).union(edges.select("a")).union(edges.select("b"))
    return graph.components(vertices, edges)


@query(None)
def supplier_part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all rows of lineitem; a part's vertex is its key plus 2 to the 40th, above every supplier."""
    return _supplier_parts(spark, sf_dir, table(spark, sf_dir, "lineitem"), 1 << 40)


COVARIATES = "cov AS (SELECT l.doc_id AS sample_id, l.quality::DOUBLE AS y, d.n_chars::DOUBLE / 1000 AS z FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL)"
WORD_DOCS = WORDS_SQL + ", wd AS (SELECT sample_id AS key, kmer AS doc FROM doc_words), kept AS (SELECT key FROM wd GROUP BY key HAVING count(*) >= 20)"


def word_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each word that at least twenty have."""
    long = doc_words(spark, sf_dir).select(F.col("sample_id").alias("kmer"), F.col("kmer").alias("sample_id"))
    return P.presence(long).where(F.size("samples") >= 20)


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("y"), (F.col("n_chars") / 1000).alias("z"))


OLS_SINGLE_SQL = f"""WITH {WORD_DOCS}, {COVARIATES}, x AS (SELECT k.key, c.y, (w.doc IS NOT NULL)::INT::DOUBLE AS x FROM kept k CROSS JOIN cov c LEFT JOIN wd w ON w.key = k.key AND w.doc = c.sample_id)"""


@query(OLS_SINGLE_SQL + """, f AS (SELECT key, sum(x)::BIGINT AS n, var_pop(x) AS v, regr_slope(y, x) AS b, regr_r2(y, x) AS r FROM x GROUP BY key)
SELECT key, n, CASE WHEN v > 1e-12 THEN round(b, 6) END AS kmer_coef, CASE WHEN v > 1e-12 THEN round(r, 6) END AS rsquared, v <= 1e-12 AS degenerate FROM f""")
def ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression of quality on each word alone."""
    fit = association.associate(word_docs(spark, sf_dir), covariates(spark, sf_dir).drop("z"), "y")
    return fit.select("key", "n", F.round("kmer_coef", 6).alias("kmer_coef"), F.round("rsquared", 6).alias("rsquared"), "degenerate")


OLS_SQL = f"""WITH {WORD_DOCS}, {COVARIATES}, g AS (SELECT count(*)::DOUBLE AS m, sum(z) AS sz, sum(z * z) AS zz, sum(y) AS sy, sum(y * z) AS yz, sum(y * y) AS yy FROM cov),
a AS (SELECT *, m * zz - sz * sz AS det FROM g),
k AS (SELECT k.key, count(c.y)::DOUBLE AS n, coalesce(sum(c.y), 0) AS xy, coalesce(sum(c.z), 0) AS xz FROM kept k JOIN wd w ON w.key = k.key LEFT JOIN cov c ON c.sample_id = w.doc GROUP BY k.key),
f AS (SELECT key, n, n - (xz * (m * xz - sz * n) + n * (zz * n - sz * xz)) / det AS den, xy - (xz * (m * yz - sz * sy) + n * (zz * sy - sz * yz)) / det AS num,
  (m * yz - sz * sy) / det AS bz, (m * xz - sz * n) / det AS pz, yy - (yz * (m * yz - sz * sy) + sy * (zz * sy - sz * yz)) / det AS rss0, yy - sy * sy / m AS tss, m FROM k, a),
o AS (SELECT *, num / den AS b FROM f WHERE den > 1e-9 * greatest(n, 1)),
t AS (SELECT *, b * sqrt(den / ((rss0 - b * b * den) / (m - 3))) AS tstat FROM o)"""


@query(OLS_SQL + """ SELECT f.key, f.n::BIGINT AS n, round(t.b, 6) AS kmer_coef, round(t.bz - t.b * t.pz, 6) AS z_coef, round(1 - (t.rss0 - t.b * t.b * t.den) / t.tss, 6) AS rsquared, t.key IS NULL AS degenerate FROM f LEFT JOIN t ON t.key = f.key""")
def ols_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression of quality on each word with a covariate."""
    fit = association.associate(word_docs(spark, sf_dir), covariates(spark, sf_dir), "y")
    return fit.select("key", "n", *[F.round(c, 6).alias(c) for c in ("kmer_coef", "z_coef", "rsquared")], "degenerate")


#: Two-sided tails by Simpson's rule over 4,000 intervals, and the 97.5 % point by its expansion in the normal one.
T_TAIL_SQL = """, e AS (SELECT key, b, abs(tstat) AS t, m - 3 AS v, sqrt((rss0 - b * b * den) / (m - 3) / den) AS se, exp(lgamma((m - 2) / 2) - lgamma((m - 3) / 2)) / sqrt((m - 3) * pi()) AS c, least(abs(tstat), 12) / 4000 AS h, 1.959963984540054::DOUBLE AS z FROM t),
q AS (SELECT *, z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) AS reach FROM e),
p AS (SELECT key, b, se, reach, greatest(0, 1 - 2 * c * h / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (i * h) * (i * h) / v) ** (-(v + 1) / 2)))) AS pval FROM q)"""


@query(OLS_SQL + T_TAIL_SQL + " SELECT f.key, round(pval, 5) AS kmer_pval, round(b - reach * se, 6) AS kmer_coef_025, round(b + reach * se, 6) AS kmer_coef_975 FROM f LEFT JOIN p ON p.key = f.key")
def ols_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values and intervals of each word's coefficient."""
    fit = association.associate(word_docs(spark, sf_dir), covariates(spark, sf_dir), "y")
    return fit.select("key", F.round("kmer_pval", 5).alias("kmer_pval"), *[F.round(c, 6).alias(c) for c in ("kmer_coef_025", "kmer_coef_975")])


@query(None)
def logit_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions of quality on each word with a covariate."""
    return association.associate(word_docs(spark, sf_dir), covariates(spark, sf_dir), "y", family="logit")


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_discount * 1e-4 <= 0.05 / n AS significant FROM lineitem, n WHERE l_quantity > 0 AND l_tax >= 0""")
def bonferroni_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or under the corrected level, and the others."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 1e-4).alias("pval"))
    return P.bonferroni(items).select("l_orderkey", "l_linenumber", "significant")


@query("SELECT sample_id, y, z FROM (WITH " + COVARIATES + " SELECT * FROM cov)")
def complete_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without missing values."""
    return association.complete_cases(covariates(spark, sf_dir)).select("sample_id", "y", "z")


def segment_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by supplier nation, with nation numbers as samples."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("sample_id"))
    return P.presence(items.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("kmer"), "sample_id").distinct())


SEGMENTS = "seg AS (SELECT DISTINCT l_partkey AS kmer, s_nationkey::BIGINT AS sample_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {SEGMENTS} SELECT x.sample_id AS i, y.sample_id AS j, count(*)::BIGINT AS shared FROM seg x JOIN seg y ON x.kmer = y.kmer AND x.sample_id <= y.sample_id GROUP BY x.sample_id, y.sample_id")
def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two nations have in common."""
    return population.gram(segment_presence(spark, sf_dir))


@query(None)
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained-variance ratios of ten components."""
    has = Scratch(spark).cut(segment_presence(spark, sf_dir))
    share = population.population_structure(has)[2]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(share)], "comp int, explained double")


@query(None)
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of ten components."""
    return population.population_structure(Scratch(spark).cut(segment_presence(spark, sf_dir)))[0]


@query(f"WITH {SEGMENTS}, c AS (SELECT p_partkey AS kmer, i::INT AS comp, ((p_partkey * 37 + i * 11) % 101 - 50) / 64.0::DOUBLE AS loading FROM part, LATERAL unnest(range(0, 3)) AS t(i)) SELECT sample_id, comp, round(sum(loading), 6) AS score FROM seg JOIN c ON c.kmer = seg.kmer GROUP BY sample_id, comp")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection of nations on three fixed components."""
    fixed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kmer"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("comp"))
    fixed = fixed.withColumn("loading", ((F.col("kmer") * 37 + F.col("comp") * 11) % 101 - 50) / 64.0)
    own = segment_presence(spark, sf_dir).select("kmer", F.explode("samples").alias("sample_id"))
    return population.project(own, fixed).select("sample_id", "comp", F.round("score", 6).alias("score"))


@query(None)
def structure_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of sample distances on shares of the keys."""
    has = Scratch(spark).cut(segment_presence(spark, sf_dir))
    samples = [r[0] for r in has.select(F.explode("samples").alias("s")).distinct().orderBy("s").collect()]
    return spark.createDataFrame(population.stability(has, samples))


@query(None)
def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of nations on disjoint blocks of the parts."""
    has = Scratch(spark).cut(segment_presence(spark, sf_dir))
    samples = [r[0] for r in has.select(F.explode("samples").alias("s")).distinct().orderBy("s").collect()]
    return spark.createDataFrame(population.block_distances(has, samples, steps=2))


@query("""WITH m AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM m GROUP BY label, i),
d AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) AS ab, sum(a.v * a.v) AS aa, sum(b.v * b.v) AS bb FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label)
SELECT a, b, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS cosine FROM d""")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the mean vectors of labels."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mine = means.select("i", F.struct("label", "v").alias("x"))
    both = mine.join(mine.withColumnRenamed("x", "y"), "i").where("x.label <= y.label").groupBy("x.label", F.col("y.label").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("dot"))
    both = both.withColumnRenamed("label", "a")
    norm = lambda c: both.where("a = b").select(F.col("a").alias(c), F.sqrt("dot").alias(f"n{c}"))
    return both.where("a < b").join(norm("a"), "a").join(norm("b"), "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


REF_SQL = f"""{ABUNDANT_SQL}, listed AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS idx FROM abundant),
two AS (SELECT kmer, idx FROM listed UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')), idx FROM listed), num AS (SELECT kmer, max(idx) AS idx FROM two GROUP BY kmer),
aligned AS (SELECT source AS gene, word FROM windows WHERE word NOT LIKE '%N%' AND (sample_id * 7 + read_no) % 61 >= 30),
genes AS (SELECT DISTINCT gene, idx FROM aligned JOIN num ON num.kmer = aligned.word)"""


def ref_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import ranked

    listed = ranked(abundant(spark, sf_dir).select("kmer"), "kmer", name="idx")
    return Scratch(spark).cut(enrichment.reference_kmers(alignments(spark, sf_dir), listed, name_re="^[a-z]+[0-9]+"))


@query(f"WITH {REF_SQL} SELECT gene, array_to_string(list_sort(list(idx)), ',') AS kmers FROM genes GROUP BY gene")
def ref_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed k-mers in the good alignments of each reference."""
    return ref_sets(spark, sf_dir).select("gene", joined("kmers").alias("kmers"))


GENE_SQL = f"""{REF_SQL}, sig AS (SELECT gene, idx FROM genes WHERE idx % 3 = 0), non AS (SELECT gene, idx FROM genes WHERE idx % 3 <> 0),
st AS (SELECT count(DISTINCT idx)::BIGINT AS n FROM sig), nt AS (SELECT count(DISTINCT idx)::BIGINT AS n FROM non),
cells AS (SELECT s.gene, s.a, st.n - s.a AS b, coalesce(x.c, 0)::BIGINT AS c, nt.n - coalesce(x.c, 0) AS d FROM (SELECT gene, count(*)::BIGINT AS a FROM sig GROUP BY gene) s LEFT JOIN (SELECT gene, count(*)::BIGINT AS c FROM non GROUP BY gene) x ON x.gene = s.gene, st, nt),
tests AS (SELECT *, (SELECT sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1))) FROM range(a, least(a + b, a + c) + 1) AS t(x)) AS p FROM cells)"""


@query(f"""WITH {GENE_SQL} SELECT gene, a, b, c, d, CASE WHEN b * c = 0 THEN -1 ELSE round(a::DOUBLE * d / (b::DOUBLE * c), 8) END AS odds, round(least(p, 1), 8) AS pvalue, p <= 0.05 / (SELECT count(*) FROM tests) AS significant FROM tests""")
def gene_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with more of one third of the k-mers than of the others."""
    genes = ref_sets(spark, sf_dir)
    part = lambda f: genes.withColumn("kmers", F.filter("kmers", f)).where(F.size("kmers") > 0)
    tested = enrichment.gene_enrichment(part(lambda i: i % 3 == 0), part(lambda i: i % 3 != 0))
    odds = F.when(F.col("b") * F.col("c") == 0, -1.0).otherwise(F.round("odds", 8))
    return tested.select("gene", "a", "b", "c", "d", odds.alias("odds"), F.round("pvalue", 8).alias("pvalue"), "significant")


@query(f"WITH {GENE_SQL} SELECT gene FROM sig UNION SELECT gene FROM non")
def found_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with any listed k-mer."""
    genes = ref_sets(spark, sf_dir)
    part = lambda f: genes.withColumn("kmers", F.filter("kmers", f)).where(F.size("kmers") > 0)
    return enrichment.found_genes(part(lambda i: i % 3 == 0), part(lambda i: i % 3 != 0))


FISHER_SQL = """WITH e AS (SELECT event_type, count(*) FILTER (WHERE value > 50)::BIGINT AS a, count(*) FILTER (WHERE NOT coalesce(value > 50, false))::BIGINT AS b FROM events GROUP BY event_type),
s AS (SELECT sum(a)::BIGINT AS sa, sum(b)::BIGINT AS sb FROM e), t AS (SELECT event_type, a, b, (sa - a)::BIGINT AS c, (sb - b)::BIGINT AS d FROM e, s),
x AS (SELECT event_type, a, b, c, d, i, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)) AS p
  FROM t, LATERAL unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS r(i)),
o AS (SELECT event_type, p AS seen FROM x WHERE i = a)
SELECT x.event_type, a, b, c, d, round(a::DOUBLE * d / (b::DOUBLE * c), 6) AS odds, round(least(1, sum(CASE WHEN i >= a THEN p ELSE 0 END)), 6) AS greater, round(least(1, sum(CASE WHEN i <= a THEN p ELSE 0 END)), 6) AS less, round(least(1, sum(CASE WHEN p <= seen * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS two_sided
FROM x JOIN o ON o.event_type = x.event_type GROUP BY x.event_type, a, b, c, d"""


@query(FISHER_SQL)
def fisher_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's test of each event type against high values, in all three tails."""
    high = F.coalesce(F.col("value") > 50, F.lit(False))
    cells = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(high.cast("bigint")).alias("a"), F.sum((~high).cast("bigint")).alias("b"))
    total = cells.agg(F.sum("a"), F.sum("b")).first()
    cells = cells.select("event_type", "a", "b", (F.lit(total[0]) - F.col("a")).alias("c"), (F.lit(total[1]) - F.col("b")).alias("d"))
    tails = {"greater": "greater", "less": "less", "two_sided": "two-sided"}
    return cells.select("*", F.round(T.odds_ratio("a", "b", "c", "d"), 6).alias("odds"), *[F.round(T.fisher("a", "b", "c", "d", t), 6).alias(n) for n, t in tails.items()])


KO_SQL = """WITH found AS (SELECT s_suppkey AS gene FROM supplier), enr AS (SELECT s_suppkey AS gene FROM supplier WHERE s_acctbal > 5000), ko AS (SELECT s_suppkey AS gene, n_name AS ko FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 3),
al AS (SELECT ko, count(*)::BIGINT AS total FROM found JOIN ko ON ko.gene = found.gene GROUP BY ko), so AS (SELECT ko, count(*)::BIGINT AS sp FROM enr JOIN ko ON ko.gene = enr.gene GROUP BY ko),
c AS (SELECT so.ko, sp, total - sp AS nsp, (SELECT count(*) FROM enr) - sp AS snp, (SELECT count(*) FROM found) - (SELECT count(*) FROM enr) - (total - sp) AS nsnp FROM so JOIN al ON al.ko = so.ko),
t AS (SELECT *, (SELECT sum(exp(lgamma(sp + nsp + 1) + lgamma(snp + nsnp + 1) + lgamma(sp + snp + 1) + lgamma(nsp + nsnp + 1) - lgamma(sp + nsp + snp + nsnp + 1) - lgamma(x + 1) - lgamma(sp + nsp - x + 1) - lgamma(sp + snp - x + 1) - lgamma(nsnp - sp + x + 1))) FROM range(sp, least(sp + nsp, sp + snp) + 1) AS r(x)) AS p FROM c)"""


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sup = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    groups = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("gene"), F.col("n_name").alias("ko"))
    return sup.select(F.col("s_suppkey").alias("gene")), sup.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("gene")), groups


@query(KO_SQL + " SELECT ko, sp, nsp, snp::BIGINT AS snp, nsnp::BIGINT AS nsnp, CASE WHEN nsp::DOUBLE * snp = 0 THEN -1 ELSE round(sp::DOUBLE * nsnp / (nsp::DOUBLE * snp), 8) END AS odds, round(least(p, 1), 8) AS pvalue, p <= 0.05 / (SELECT count(*) FROM t) AS significant FROM t")
def ko_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with more rich suppliers than the others."""
    tested = enrichment.group_enrichment(*annotated(spark, sf_dir))
    return tested.select("ko", "sp", "nsp", "snp", "nsnp", F.round("odds", 8).alias("odds"), F.round("pvalue", 8).alias("pvalue"), "significant")


@query("SELECT s_suppkey AS gene FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3 AND s_acctbal > 5000")
def no_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich suppliers without a group."""
    _, rich, groups = annotated(spark, sf_dir)
    return enrichment.without_group(rich, groups)


@query("""WITH i AS (SELECT c_mktsegment AS segment, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), n AS (SELECT count(*)::DOUBLE AS n FROM i),
s AS (SELECT CASE WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(nation) = 0 THEN 'nation' ELSE 'region' END AS level, coalesce(segment, nation, region) AS name, count(*) AS k FROM i GROUP BY GROUPING SETS ((segment), (nation), (region))),
p AS (SELECT level, name, k / n AS share FROM s, n)
SELECT level, name, round(share, 9) AS share FROM p WHERE share >= 0.03 UNION ALL SELECT level, 'Other', round(sum(CASE WHEN share < 0.03 THEN share ELSE 0 END), 9) FROM p GROUP BY level""")
def taxonomy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of customers at three levels, small ones as Other."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = enrichment.shares(items.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")), ["segment", "nation", "region"])
    return out.select("level", "name", F.round("share", 9).alias("share"))


@query("""WITH c AS (SELECT p_partkey AS ko, p_type AS category FROM part WHERE p_type <> 'none'), f AS (SELECT category, count(*)::BIGINT AS n_found FROM c GROUP BY category ORDER BY n_found DESC, category LIMIT 10)
SELECT f.category, n_found, count(p_partkey)::BIGINT AS n_sig FROM f LEFT JOIN c ON c.category = f.category LEFT JOIN part ON p_partkey = c.ko AND p_size > 25 GROUP BY f.category, n_found""")
def category_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent part types, with large parts counted."""
    part = table(spark, sf_dir, "part")
    keys, cats = part.select(F.col("p_partkey").alias("ko")), part.select(F.col("p_partkey").alias("ko"), F.col("p_type").alias("category"))
    return enrichment.category_counts(keys, part.where("p_size > 25").select(F.col("p_partkey").alias("ko")), cats, excluded=("none",))


@query("""SELECT c_custkey, round(100.0::DOUBLE * c_acctbal / 10000, 6) AS pct, (list_position(l, list_min(l)) - 1)::BIGINT AS lowest, (list_position(l, list_max(l)) - 1)::BIGINT AS highest, array_to_string(string_split(c_name, '#'), '|') AS parts,
  CASE WHEN c_mktsegment LIKE 'AUTO%' THEN 'AUTO' ELSE c_mktsegment END AS seg, replace(c_name, 'Customer#', '') AS trimmed, (sign(c_custkey % 9 - 4) * floor(abs(c_custkey % 9 - 4) / 2.0::DOUBLE + 0.5))::BIGINT AS halved FROM (SELECT *, [c_custkey % 7, c_custkey % 5, c_nationkey::BIGINT] AS l FROM customer)""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small helpers: percentages, first places of extrema, splitting, prefixes."""
    c = table(spark, sf_dir, "customer").withColumn("l", F.array(F.col("c_custkey") % 7, F.col("c_custkey") % 5, F.col("c_nationkey").cast("bigint")))
    seg = A.cut_suffix(F.regexp_replace("c_mktsegment", "^AUTO", "AUTO_"), "AUTO")
    return c.select("c_custkey", F.round(A.percent("c_acctbal", F.lit(10000)), 6).alias("pct"), A.arg_min("l").alias("lowest"), A.arg_max("l").alias("highest"), F.array_join(A.split_parts("c_name", "#"), "|").alias("parts"), seg.alias("seg"), A.cut_prefix("c_name", "Customer#").alias("trimmed"), A.round_div(F.col("c_custkey") % 9 - 4, F.lit(2)).alias("halved"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS l FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_transform(range(0, 5), lambda i: l[floor(i / 4.0 * (len(l) - 1) + 0.5)::BIGINT + 1]::DECIMAL(18, 2)), ',') AS tiles FROM s""")
def order_ntiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by nearest rank of each customer's orders."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("l"))
    return lists.select("o_custkey", F.array_join(A.ntiles(4, "l").cast("array<decimal(18,2)>").cast("array<string>"), ",").alias("tiles"))


