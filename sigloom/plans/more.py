"""Queries for signatures, splits, evaluation, prediction, population and exports, over the same stand-ins as the catalogue's."""

from __future__ import annotations

from pyspark.ml.stat import Correlation
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigloom.functions import scalars as S
from sigloom.operators import etl
from sigloom.operators import labels as L
from sigloom.operators import metrics as E
from sigloom.operators import population as P
from sigloom.operators import prediction as R
from sigloom.operators import signatures as G
from sigloom.plans import models
from sigloom.plans.catalogue import BEST, CLEAN, PROPERTIES, SC, SD, TR, labels, query, scores, t, truths, views
from sigloom.sources import sqlsurface

# --- signatures: documents' letters stand for aligned queries, W for a gap; K, S and W for gaps of the profile ------------


def alignments(spark, sf):
    docs = t(spark, sf, "documents").filter("text is not null").select("doc_id", S.letters(F.col("text")).alias("a")).filter("length(a) >= 34")
    query, profile = S.replaced(F.col("a"), "W", "-"), S.replaced(F.col("a"), "KSW", "-.-")
    return L.checkpointed(docs.select("doc_id", query.alias("query"), profile.alias("profile"), F.reverse(query).alias("c_query"), F.reverse(profile).alias("c_profile")))


ALIGNED = f"d AS (SELECT doc_id, {CLEAN} AS a FROM documents WHERE text IS NOT NULL), al AS (SELECT doc_id, translate(a, 'W', '-') AS q, translate(a, 'KSW', '-.-') AS p FROM d WHERE len(a) >= 34)"
HEAD = "regexp_extract({p}, '^(?:[{gaps}]*[^{gaps}]){{0,{most}}}')"
UNGAPPED = f"list_filter(range(len({HEAD})), lambda i: NOT regexp_matches(substr({HEAD}, CAST(i + 1 AS INT), 1), '[{{gaps}}]'))"
AT = "list_filter(list_transform({positions}, lambda p: CASE WHEN p - {off} >= 0 THEN {cols}[p - {off} + 1] END), lambda c: c IS NOT NULL)"
LETTERS = "array_to_string(list_transform({at}, lambda c: substr({q}, CAST(c + 1 AS INT), 1)), '')"
PLACES = "array_to_string(list_transform({at}, lambda c: CASE WHEN substr({q}, CAST(c + 1 AS INT), 1) = '-' THEN 'x' ELSE CAST(len(replace(left({q}, c), '-', '')) + {start} AS VARCHAR) END), ',')"
LEGAL = "^[ACDEFGHIKLMNPQRSTVWY-]+$"


def shown(places):
    return F.array_join(F.transform(places, lambda x: F.coalesce(x.cast("string"), F.lit("x"))), ",")


def _profile_sql() -> str:
    at = lambda positions, off, cols: AT.format(positions=positions, off=off, cols=cols)
    whole = lambda name, size: f"CASE WHEN len({name}) = {size} THEN {name} END"
    return f"""WITH {ALIGNED}, c AS (SELECT *, {UNGAPPED.format(p='p', gaps='-.', most=166)} AS cols, reverse(q) AS qc, {UNGAPPED.format(p='reverse(p)', gaps='-.', most=37)} AS cc FROM al),
      x AS (SELECT *, {at(G.SIGNATURE, '(doc_id % 50)', 'cols')} AS s, {at(G.EXTENDED, '(doc_id % 50)', 'cols')} AS e, {at(G.LYSINE, '(doc_id % 40)', 'cc')} AS k FROM c),
      y AS (SELECT *, {whole('s', 9)} AS s1, {whole('e', 34)} AS e1, CASE WHEN len(k) = 1 THEN substr(qc, CAST(k[1] + 1 AS INT), 1) END AS lys FROM x),
      z AS (SELECT *, {LETTERS.format(at='s1', q='q')} AS sig, {LETTERS.format(at='e1', q='q')} AS ext FROM y)
      SELECT doc_id, CASE WHEN regexp_matches(sig, '{LEGAL}') THEN sig || CASE WHEN regexp_matches(lys, '^[ACDEFGHIKLMNPQRSTVWY]$') THEN lys ELSE 'K' END END AS signature, CASE WHEN regexp_matches(sig, '{LEGAL}') THEN {PLACES.format(at='s1', q='q', start='doc_id')} END AS positions,
        CASE WHEN regexp_matches(ext, '{LEGAL}') THEN ext END AS extended_signature, CASE WHEN regexp_matches(ext, '{LEGAL}') THEN {PLACES.format(at='e1', q='q', start='doc_id')} END AS extended_positions FROM z"""


@query(_profile_sql())
def signature_from_alignment(spark, sf):
    hits = alignments(spark, sf).select("doc_id", F.col("query").alias("n_query"), F.col("profile").alias("n_profile"), (F.col("doc_id") % 50).cast("int").alias("n_hit_start"), F.col("doc_id").alias("n_query_start"), "c_query", "c_profile", (F.col("doc_id") % 40).cast("int").alias("c_hit_start"))
    out = G.profile_signatures(hits)
    return out.select("doc_id", "signature", shown(F.col("signature_positions")).alias("positions"), "extended_signature", shown(F.col("extended_positions")).alias("extended_positions"))


def _reference_sql() -> str:
    at = lambda positions: AT.format(positions=[p - G.REFERENCE_START for p in positions], off="0", cols="cols")
    return f"""WITH {ALIGNED}, c AS (SELECT *, {UNGAPPED.format(p="translate(p, '.', 'S')", gaps='-', most=269)} AS cols FROM al), x AS (SELECT *, {at(G.REFERENCE_SIGNATURE)} AS s, {at(G.REFERENCE_EXTENDED)} AS e FROM c)
      SELECT doc_id, {LETTERS.format(at='s', q='q')} AS signature, {LETTERS.format(at='e', q='q')} AS extended_signature, {PLACES.format(at='s', q='q', start='5')} AS positions FROM x"""


@query(_reference_sql())
def signature_from_reference(spark, sf):
    pairs = alignments(spark, sf).select("doc_id", F.col("query").alias("aligned"), F.translate("profile", ".", "S").alias("reference"), F.lit(5).alias("start"))
    return G.reference_signatures(pairs).select("doc_id", "signature", "extended_signature", shown(F.col("signature_positions")).alias("positions"))


@query("SELECT event_id, substr(text, CAST(floor(value) AS INT) + 1, CAST(user_id % 40 AS INT)) AS sequence FROM events JOIN documents ON user_id = doc_id WHERE text IS NOT NULL")
def domain_slices(spark, sf):
    start = F.floor("value").cast("int")
    domains = t(spark, sf, "events").select("event_id", F.col("user_id").alias("protein_id"), start.alias("start"), (start + F.col("user_id") % 40).cast("int").alias("end"))
    proteins = t(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("protein_id"), F.col("text").alias("protein_sequence"))
    return G.slices(domains, proteins).select("event_id", "sequence")


@query("SELECT p_partkey AS id FROM part WHERE p_name <> '' AND p_brand <> 'Brand#13' AND p_size <= 40 AND p_partkey % 5 <> 0")
def completeness_filter(spark, sf):
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence"), F.nullif("p_brand", F.lit("Brand#13")).alias("signature"), F.when(F.col("p_size") <= 40, F.col("p_type")).otherwise("").alias("extended_signature"), (F.col("p_partkey") % 5).alias("domain_nr"))
    return G.complete(part).select("id")


def taxa(spark, sf):
    """Suppliers with ranks: nations are phyla; regions stand for domains of life and kingdoms."""
    rank = lambda a, b: F.when(F.col("r_name") == a, b).otherwise(F.col("r_name"))
    joined = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("protein_id"), rank("ASIA", "Bacteria").alias("domain"), rank("EUROPE", "Fungi").alias("kingdom"), F.col("n_name").alias("phylum"))


TAXA = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT s_suppkey AS protein_id, 'fungal' AS scope FROM {TAXA} WHERE r_name = 'EUROPE' UNION ALL SELECT s_suppkey, 'bacterial' FROM {TAXA} WHERE r_name = 'ASIA' UNION ALL SELECT s_suppkey, 'all' FROM supplier")
def scope_filter(spark, sf):
    every, out = taxa(spark, sf), None
    for scope in ("fungal", "bacterial", "all"):
        part = G.scoped(every, scope).select("protein_id", F.lit(scope).alias("scope"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT n_name AS taxon, count(*) AS n FROM {TAXA} GROUP BY n_name")
def rank_counts(spark, sf):
    return taxa(spark, sf).groupBy(G.rank_column("Phylum").alias("taxon")).agg(F.count(F.lit(1)).alias("n"))


# --- names -----------------------------------------------------------------------------------------------------------

@query("SELECT o_orderkey AS id, 'p' || o_custkey || '_x|domain:' || (o_orderkey % 9) || '|' || (o_orderkey % 70) || '.' || (o_orderkey % 70 + 500) AS header, o_orderkey % 9 AS number, 'p' || o_custkey || '_x' AS protein FROM orders")
def domain_headers(spark, sf):
    name = F.concat(F.lit("p"), "o_custkey", F.lit("_x"))
    synonym = F.concat(name, F.lit(".A"), F.col("o_orderkey") % 9)
    rows = t(spark, sf, "orders").select("o_orderkey", synonym.alias("synonym"))
    protein = S.protein_of(F.col("synonym"))
    header = S.header(protein, S.domain_number(F.col("synonym")), F.col("o_orderkey") % 70, F.col("o_orderkey") % 70 + 500, "|", ":", ".")
    return rows.select(F.col("o_orderkey").alias("id"), header.alias("header"), S.domain_number(F.col("synonym")).cast("long").alias("number"), protein.alias("protein"))


@query("SELECT p_partkey AS id, regexp_extract(p_name, '^\\S+') AS name FROM part")
def display_names(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.display_name(F.col("p_name")).alias("name"))


@query("SELECT row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS number, c_custkey AS id FROM customer")
def surrogate_names(spark, sf):
    return P.surrogates(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id").select("number", "id")


@query("SELECT DISTINCT replace(s_name, '#', '_') || '.A' || (l_orderkey % 7) AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def clean_names(spark, sf):
    supplier = t(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("id"))
    lines = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 7).alias("n")).distinct()
    domains = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat("id", F.lit(".A"), "n").alias("id"))
    return P.cleaned_names(supplier.select("id"), domains, "#", "_")[1].distinct()


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'New domain entries' WHEN 1 THEN 'Domain corrections' ELSE 'Domain sequence revision' END AS title FROM events")
def entry_titles(spark, sf):
    kind = F.element_at(F.array(F.lit("new_entry"), F.lit("correction"), F.lit("duplicate_entry")), (F.col("event_id") % 3).cast("int") + 1)
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), P.entry_title(kind).alias("title"))


@query("SELECT 'x' || (o_orderkey % 500) AS id, min(o_orderpriority) AS value FROM orders WHERE o_orderkey < 500 GROUP BY 1")
def remap_names(spark, sf):
    rows = t(spark, sf, "orders").filter("o_orderkey < 500").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    return L.remapped(rows, rows.select("id", F.concat(F.lit("x"), F.col("id") % 500).alias("new_id")))


# --- splits ----------------------------------------------------------------------------------------------------------

RAREST = f"{SD}, cn AS (SELECT label, count(DISTINCT domain_id) AS c FROM sd GROUP BY label), ra AS (SELECT domain_id, label FROM (SELECT domain_id, label, row_number() OVER (PARTITION BY domain_id ORDER BY c, label) AS k FROM sd JOIN cn USING (label)) WHERE k = 1)"
RK = "row_number() OVER (PARTITION BY label ORDER BY md5(CAST(domain_id AS VARCHAR)), domain_id)"


@query(f"WITH {RAREST} SELECT domain_id, CASE WHEN {RK} <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS side FROM ra")
def multilabel_split(spark, sf):
    return L.multilabel_split(labels(spark, sf), 0.25)


@query(f"WITH {RAREST} SELECT domain_id, ({RK} - 1) % 5 AS fold FROM ra")
def multilabel_folds(spark, sf):
    return L.multilabel_folds(labels(spark, sf), 5)


@query("WITH b AS (SELECT DISTINCT l_orderkey AS domain_id, l_linenumber AS label FROM lineitem) SELECT domain_id, string_agg(CASE WHEN b.label IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.label) AS hot FROM (SELECT DISTINCT domain_id FROM b) d CROSS JOIN (SELECT DISTINCT label FROM b) c LEFT JOIN b USING (domain_id, label) GROUP BY domain_id")
def multi_hot(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("domain_id"), F.col("l_linenumber").alias("label"))
    return L.multi_hot(rows)[1].select("domain_id", F.array_join(F.col("hot").cast("array<string>"), "").alias("hot"))


def domain_clades(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("domain_id"), F.col("c_nationkey").alias("clade"))


def brands(spark, sf):
    """Domains' brands in the order of their lines, each once: labels that are few."""
    every = labels(spark, sf).join(t(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_brand").alias("brand")), "label")
    return every.select("domain_id", F.col("brand").alias("label"), F.col("ordinal").cast("long").alias("ordinal"))


BRANDS = f"{SD}, br AS (SELECT domain_id, p_brand AS label, ordinal FROM sd JOIN part ON label = p_partkey), ib AS (SELECT label FROM br GROUP BY label HAVING count(*) >= 200), cl AS (SELECT o_orderkey AS domain_id, c_nationkey AS clade FROM orders JOIN customer ON o_custkey = c_custkey)"
VALID = "v AS (SELECT domain_id, arg_min(label, ordinal) AS label FROM br WHERE label IN (SELECT label FROM ib) GROUP BY domain_id)"


@query(f"WITH {BRANDS}, {VALID} SELECT clade, label, count(v.domain_id) AS n FROM (SELECT DISTINCT clade FROM cl) c CROSS JOIN (SELECT label FROM ib) i LEFT JOIN (SELECT v.domain_id, clade, label FROM v JOIN cl USING (domain_id)) v USING (clade, label) GROUP BY clade, label")
def clade_counts_first_valid(spark, sf):
    every = brands(spark, sf)
    return L.clade_counts(every, domain_clades(spark, sf), L.label_counts(every, cutoff=200), "first_valid")


@query(f"WITH {BRANDS} SELECT clade, label, count(*) AS n FROM br JOIN cl USING (domain_id) WHERE ordinal = 0 AND label IN (SELECT label FROM ib) GROUP BY clade, label")
def clade_counts_first(spark, sf):
    every = brands(spark, sf)
    return L.clade_counts(every, domain_clades(spark, sf), L.label_counts(every, cutoff=200), "first_only")


@query(f"WITH {RAREST}, sp AS (SELECT domain_id, CASE WHEN {RK} <= floor(count(*) OVER (PARTITION BY label) * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS side FROM ra) SELECT label, count(*) FILTER (side = 'train') AS train, count(*) FILTER (side = 'test') AS test FROM sd JOIN sp USING (domain_id) GROUP BY label")
def split_table(spark, sf):
    every = labels(spark, sf)
    both = every.join(L.multilabel_split(every, 0.25), "domain_id")
    count = lambda side: F.count(F.when(F.col("side") == side, 1)).alias(side)
    return both.groupBy("label").agg(count("train"), count("test"))


@query()
def split_on_rank(spark, sf):
    """(clade, label, side, n): clades on sides so that every label is on both, near the ratio."""
    every = brands(spark, sf)
    counts = L.checkpointed(L.clade_counts(every, domain_clades(spark, sf), L.label_counts(every, first_only=True, cutoff=6), "first_only"))
    sides = spark.createDataFrame(list(L.rank_split(counts).items()), "clade int, side string")
    return counts.join(F.broadcast(sides), "clade").select("clade", "label", "side", "n")


@query("SELECT o_orderkey AS domain_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND n_regionkey = 3")
def scope_in_test(spark, sf):
    fungal = domain_clades(spark, sf).join(t(spark, sf, "nation").filter("n_regionkey = 3"), F.col("clade") == F.col("n_nationkey")).select("domain_id")
    test = t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("domain_id"))
    return test.join(fungal, "domain_id", "left_semi")


@query("SELECT o_orderkey AS domain_id, o_orderpriority AS side FROM orders")
def checked_split(spark, sf):
    assigned = t(spark, sf, "orders").select(F.col("o_orderkey").alias("domain_id"), F.col("o_orderpriority").alias("side"))
    L.check_split(assigned, assigned.select("domain_id"))
    return assigned


# --- evaluation ------------------------------------------------------------------------------------------------------

WALK = "j AS (SELECT tr.*, b.label AS guess FROM tr JOIN b USING (id)), h AS (SELECT *, min(CASE WHEN label = guess THEN ordinal END) OVER (PARTITION BY id) AS stop FROM j)"


@query(f"WITH {SC}, {TR}, {BEST}, {WALK}, o AS (SELECT 'all' AS label, count(*) FILTER (EXISTS (SELECT 1 FROM tr WHERE tr.id = b.id AND tr.label = b.label)) AS c, count(*) AS n FROM b UNION ALL SELECT label, count(*) FILTER (label = guess), count(*) FROM h WHERE stop IS NULL OR ordinal <= stop GROUP BY label) SELECT label AS substrate, printf('%.3f', c / n) AS accuracy FROM o")
def accuracy_table(spark, sf):
    return E.accuracy_table(E.best(scores(spark, sf)), truths(spark, sf))


@query(f"""WITH {SC}, {TR}, {BEST}, m AS (SELECT *, EXISTS (SELECT 1 FROM tr WHERE tr.id = b.id AND tr.label = b.label) AS r FROM b)
  SELECT coalesce(label, 'all') AS substrate, coalesce(printf('%.3f', avg(p) FILTER (r)), 'N/A') AS confidence_correct, coalesce(printf('%.3f', stddev_samp(p) FILTER (r)), 'N/A') AS stdev_correct, coalesce(printf('%.3f', avg(p) FILTER (NOT r)), 'N/A') AS confidence_incorrect, coalesce(printf('%.3f', stddev_samp(p) FILTER (NOT r)), 'N/A') AS stdev_incorrect FROM m GROUP BY ROLLUP (label)""")
def confidence_table(spark, sf):
    return E.confidence_table(E.best(scores(spark, sf)), truths(spark, sf))


@query(f"WITH {SC}, {TR}, {BEST}, c AS (SELECT b.label AS guess, tr.label AS actual FROM b JOIN tr ON b.id = tr.id AND tr.ordinal = 0) SELECT 'L' || i AS guess, " + ", ".join(f"count(*) FILTER (actual = 'L{k}') AS L{k}" for k in range(10)) + " FROM range(10) r(i) LEFT JOIN c ON guess = 'L' || i GROUP BY i")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(E.best(scores(spark, sf)), truths(spark, sf), [f"L{k}" for k in range(10)])


def _report_sql() -> str:
    kinds = {"tp": "r AND own", "fp": "NOT r AND own", "tn": "r AND NOT tru", "fn": "NOT r AND tru"}
    pick = lambda how, what: ", ".join(f"round({how}(p) FILTER ({c}), 9) AS {what}_prob_{k}" for k, c in kinds.items())
    return f"""WITH {SC}, {TR}, {BEST}, tt AS (SELECT DISTINCT id, label FROM tr),
      x AS (SELECT sc.id, sc.label, sc.p, b.label AS best, coalesce(b.label = sc.label, false) AS own, tt.label IS NOT NULL AS tru, EXISTS (SELECT 1 FROM tt u WHERE u.id = b.id AND u.label = b.label) AS r, rank() OVER (PARTITION BY sc.id ORDER BY sc.p DESC) AS rk FROM sc LEFT JOIN b ON b.id = sc.id LEFT JOIN tt ON tt.id = sc.id AND tt.label = sc.label),
      z AS (SELECT id, label, p, best, own, tru, rk, CASE WHEN best IS NULL THEN NULL ELSE r END AS r FROM x),
      l AS (SELECT coalesce(label, 'all') AS label, {", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in kinds.items())}, round(avg(rk) FILTER (tru), 9) AS mean_rank_correct, round(stddev_samp(rk) FILTER (tru), 9) AS sd_rank_correct, round(avg(rk) FILTER (NOT tru), 9) AS mean_rank_incorrect, round(stddev_samp(rk) FILTER (NOT tru), 9) AS sd_rank_incorrect FROM z GROUP BY ROLLUP (label)),
      q AS (SELECT coalesce(best, 'all') AS label, {pick('avg', 'mean')}, {pick('stddev_samp', 'sd')} FROM z WHERE best IS NOT NULL GROUP BY ROLLUP (best))
      SELECT l.*, q.* EXCLUDE (label), round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) END AS f1 FROM l LEFT JOIN q USING (label)"""


@query(_report_sql())
def pair_report(spark, sf):
    out = E.pair_report(scores(spark, sf), truths(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("label", "tp", "fp", "tn", "fn")})


@query("WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings) SELECT a.i AS a, b.i AS b, round(greatest(0, 1 - corr(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE))), 6) + 0.0 AS distance FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def correlation_distances(spark, sf):
    """1 - r of every two columns, at least 0: what a clustering of properties starts from. The matrix is as large as the columns are many, squared."""
    vectors = t(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    rows = Correlation.corr(vectors, "v").first()[0].toArray()
    cells = [(i, k, float(r)) for i, row in enumerate(rows) for k, r in enumerate(row)]
    return spark.createDataFrame(cells, "a long, b long, r double").select("a", "b", (F.round(F.greatest(F.lit(0.0), 1 - F.col("r")), 6) + F.lit(0.0)).alias("distance"))


# --- prediction ------------------------------------------------------------------------------------------------------

def signed(spark, sf):
    """Documents' first 34 letters as signatures, their languages as labels."""
    docs = t(spark, sf, "documents").filter("text is not null and lang is not null").select(F.col("doc_id").alias("id"), S.residues(F.col("text"), 34).alias("extended_signature"), "lang")
    return docs.filter("length(extended_signature) = 34")


def structures(spark):
    """Stand-in structures of the four languages."""
    return spark.createDataFrame([("de", "CC"), ("en", "CCO"), ("es", "CCN"), ("fr", "CCC")], "label string, smiles string")


@query()
def predict_signatures(spark, sf):
    """(id, label, smiles, p): every label's probability for each signature, by a forest (20 trees, depth 8) that learned from three quarters of them."""
    rows = signed(spark, sf)
    learn = rows.filter("id % 4 <> 0").withColumn("label", F.col("lang"))
    model = models.train_forest(R.featured(learn, PROPERTIES), trees=20, depth=8)
    return R.predict_labels(rows.filter("id % 4 = 0"), model, structures(spark), PROPERTIES)


@query()
def predict_pairs(spark, sf):
    """(id, label, smiles, p): the interaction of each signature with each candidate, by a forest over pairs (10 trees, depth 6)."""
    rows = signed(spark, sf)
    known = structures(spark).withColumn("bits", F.array(*[(F.col("label") == x).cast("int") for x in ("de", "en", "es", "fr")]))
    truth = rows.select(F.col("id").alias("domain_id"), F.col("lang").alias("label"))
    model = R.train_pairs(rows.filter("id % 4 <> 0"), truth, known, PROPERTIES, trees=10, depth=6)
    return R.predict_pairs(rows.filter("id % 4 = 0"), model, known, PROPERTIES)


@query("SELECT doc_id AS id, r_name AS label, 102 + r_regionkey AS size FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND len(" + CLEAN + ") >= 34) CROSS JOIN region")
def pair_features(spark, sf):
    known = t(spark, sf, "region").select(F.col("r_name").alias("label"), F.lit("C").alias("smiles"), F.array_repeat(F.lit(1), F.col("r_regionkey")).alias("bits"))
    return R.paired(R.featured(signed(spark, sf), PROPERTIES), known).select("id", "label", F.size("features").cast("long").alias("size"))


@query("SELECT vec_id AS id, 'L' || i AS label, n_name AS smiles FROM embeddings CROSS JOIN range(10) r(i) JOIN nation ON n_nationkey = i")
def label_structures(spark, sf):
    known = t(spark, sf, "nation").select(F.concat(F.lit("L"), "n_nationkey").alias("label"), F.col("n_name").alias("smiles"))
    return R.with_structures(scores(spark, sf), known).select("id", "label", "smiles")


@query("SELECT n.p_partkey AS ord, p.p_name AS label FROM part n JOIN (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_size > 10 GROUP BY p_name) p ON n.p_name = p.p_name")
def candidate_labels(spark, sf):
    part = t(spark, sf, "part")
    known = part.filter("p_size > 10").groupBy(F.col("p_name").alias("label")).agg(F.min("p_brand").alias("smiles"), F.first(F.array(F.lit(1))).alias("bits"))
    return R.candidates(part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("label")), known).select("ord", "label")



@query("""WITH kn AS (SELECT o_orderkey AS domain_id, o_orderpriority || o_custkey AS sequence, 'p' || (o_orderkey % 3000) AS name FROM orders), pr AS (SELECT c_custkey AS id, 'p' || c_custkey AS protein, '1-URGENT' || c_custkey AS sequence FROM customer)
  SELECT id, protein, coalesce((SELECT string_agg(DISTINCT domain_id, ',' ORDER BY domain_id) FROM kn WHERE kn.sequence = pr.sequence), '') AS by_sequence, coalesce((SELECT string_agg(DISTINCT domain_id, ',' ORDER BY domain_id) FROM kn WHERE kn.name = pr.protein), '') AS by_name FROM pr""")
def annotate_predictions(spark, sf):
    known = t(spark, sf, "orders").select(F.col("o_orderkey").alias("domain_id"), F.concat("o_orderpriority", "o_custkey").alias("sequence"), F.array(F.concat(F.lit("p"), F.col("o_orderkey") % 3000)).alias("synonyms"))
    new = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), "c_custkey").alias("protein"), F.concat(F.lit("1-URGENT"), "c_custkey").alias("sequence"))
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return R.annotate(new, known).select("id", "protein", show("sequence_matches").alias("by_sequence"), show("name_matches").alias("by_name"))


@query("SELECT 's' || user_id AS protein, min(event_id) AS ord, string_agg(event_type, ',' ORDER BY event_id) AS results FROM events GROUP BY 1")
def protein_results(spark, sf):
    rows = t(spark, sf, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("s"), "user_id").alias("protein"), "event_type")
    return R.by_protein(rows, "event_type").select("protein", "ord", F.array_join(F.transform("results", lambda r: r["event_type"]), ",").alias("results"))


@query("""SELECT o_orderkey AS id, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS body FROM orders""")
def result_json(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.result_json(["o_orderkey", "o_orderpriority"]).alias("body"))


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS domain_nr FROM events")
def job_numbering(spark, sf):
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("protein"), F.col("event_type").alias("name"), F.col("event_id").alias("start"))
    return R.numbered_by_protein(rows).select("id", "domain_nr")


@query("""WITH p AS (SELECT doc_id, text, substr(text, 11, 4) AS tok FROM documents WHERE text IS NOT NULL AND len(text) >= 14), s AS (SELECT doc_id, len(tok) AS w, string_split(text, tok) AS parts FROM p),
  i AS (SELECT doc_id, w, parts, unnest(range(1, len(parts))) AS nth FROM s) SELECT doc_id AS protein_id, CAST(nth AS BIGINT) AS number, CAST(list_sum(list_transform(parts[1:nth], lambda x: len(x))) + (nth - 1) * w AS BIGINT) AS "start" FROM i""")
def domain_links(spark, sf):
    """Four letters of each document found again all over it: the n-th place gets the n-th number."""
    docs = t(spark, sf, "documents").filter("text is not null and length(text) >= 14")
    pairs = docs.select(F.col("doc_id").alias("protein_id"), F.col("doc_id").alias("domain_id"), F.col("text").alias("sequence"), F.substring("text", 11, 4).alias("domain"))
    places = L.checkpointed(etl.located(pairs))
    w = Window.partitionBy("protein_id").orderBy(F.desc("start"))
    numbers = places.select("protein_id", "domain_id", F.row_number().over(w).alias("number"))
    return etl.link_domains(pairs, numbers).select("protein_id", F.col("number").cast("long").alias("number"), F.col("start").cast("long").alias("start"))


# --- population and exports ------------------------------------------------------------------------------------------

def catalogue_tables(spark, sf):
    """Suppliers as proteins, parts as substrates, orders as domains of their lines' parts; three parts and two names each have several."""
    part = t(spark, sf, "part")
    domains = t(spark, sf, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("domain_id"), F.concat("o_orderpriority", F.lit("/"), "o_orderkey").alias("sequence"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("signature"), F.lpad(F.col("o_custkey").cast("string"), 34, "0").alias("extended_signature"))
    name = F.concat("p_name", F.lit("#"), "p_partkey")
    lines = labels(spark, sf).join(part.select(F.col("p_partkey").alias("label"), name.alias("name")), "label")
    return {
        "proteins": t(spark, sf, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("protein_id"), F.concat(F.lit("SEQ"), "s_suppkey").alias("sequence")),
        "protein_synonyms": t(spark, sf, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("protein_id"), F.explode(F.array("s_name", F.concat(F.lit("alias"), "s_suppkey"))).alias("synonym")),
        "substrates": part.select(name.alias("name"), F.concat(F.lit("C"), "p_partkey").alias("smiles"), F.array(F.col("p_partkey")).alias("fingerprint")),
        "domains": domains,
        "domain_synonyms": domains.select("domain_id", F.explode(F.array(F.concat("domain_id", F.lit(".A1")), F.concat(F.lit("x"), "domain_id", F.lit(".A2")))).alias("synonym")),
        "domain_substrates": lines.select(F.concat(F.lit("d"), "domain_id").alias("domain_id"), "name", F.col("ordinal").cast("int").alias("ordinal")),
    }


LINKED = f"{SD}, ls AS (SELECT domain_id, string_agg(p_name || '#' || label, '|' ORDER BY ordinal) AS labels FROM sd JOIN part ON label = p_partkey GROUP BY domain_id)"


@query(f"WITH {LINKED} SELECT 'd' || o_orderkey || '.A1|xd' || o_orderkey || '.A2' AS domain_id, o_orderpriority || '/' || o_orderkey AS sequence, labels AS specificity FROM orders JOIN ls ON o_orderkey = domain_id")
def flat_file_dataset(spark, sf):
    return P.flat_files(catalogue_tables(spark, sf))["dataset"]


@query("SELECT 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '|alias' || s_suppkey AS id, 'SEQ' || s_suppkey AS seq FROM supplier")
def flat_file_proteins(spark, sf):
    return P.flat_files(catalogue_tables(spark, sf))["proteins"]


@query("SELECT p_name || '#' || p_partkey AS substrate, 'C' || p_partkey AS smiles FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def flat_file_smiles(spark, sf):
    return P.flat_files(catalogue_tables(spark, sf))["smiles"]


@query(f"WITH {LINKED} SELECT 'd' || domain_id || '.A1|xd' || domain_id || '.A2' AS name, labels FROM ls JOIN orders ON o_orderkey = domain_id")
def domain_label_map(spark, sf):
    return P.domain_labels(catalogue_tables(spark, sf))


@query("SELECT 'd' || o_orderkey || '.A1|xd' || o_orderkey || '.A2' AS id, o_orderpriority || '/' || o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0")
def listed_domains(spark, sf):
    names = t(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("d"), "o_orderkey", F.lit(".A1|other")).alias("name"))
    return P.listed_domains(catalogue_tables(spark, sf), names)


@query("SELECT o_orderkey AS number, 'd' || o_orderkey || '.A1' AS domain_id, o_orderpriority AS sequence, 'a|' || o_custkey AS specificity FROM orders")
def issue_dataset(spark, sf):
    entry = F.struct(F.concat(F.lit("d"), "o_orderkey", F.lit(".A1")).alias("name"), F.col("o_orderpriority").alias("sequence"), F.lit("S").alias("signature"), F.lit("E").alias("extended_signature"), F.array(F.lit("a"), F.col("o_custkey").cast("string")).alias("substrates"))
    body = F.to_json(F.struct(F.lit("p").alias("protein_name"), F.lit("M").alias("protein_sequence"), F.array(entry).alias("domains")))
    issues = t(spark, sf, "orders").select(F.col("o_orderkey").alias("number"), F.concat(F.lit("New\n```json\n"), body, F.lit("\n```\n")).alias("body"))
    return P.issue_files(issues)["dataset"]


@query(f"""WITH {LINKED}, n AS (SELECT domain_id AS k FROM ls WHERE domain_id % 10 = 7) SELECT 'domains' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'domain_synonyms', 2 * count(*) FILTER (o_orderkey % 10 <> 7 OR o_orderkey NOT IN (SELECT k FROM n)) + 3 * count(*) FILTER (o_orderkey IN (SELECT k FROM n)) FROM orders
  UNION ALL SELECT 'proteins', count(*) + 1 FROM supplier UNION ALL SELECT 'protein_synonyms', 2 * count(*) + count(*) FILTER (s_suppkey % 2 = 0) + 1 FROM supplier UNION ALL SELECT 'substrates', count(*) + 1 FROM part UNION ALL SELECT 'domain_substrates', count(*) FROM sd WHERE domain_id IN (SELECT o_orderkey FROM orders)""")
def populated_counts(spark, sf):
    """How many rows a catalogue's tables have once entries are added: known ones under new names, and new ones."""
    tables = catalogue_tables(spark, sf)
    tables["domain_substrates"] = tables["domain_substrates"].join(tables["domains"], "domain_id", "left_semi")
    again = tables["proteins"].filter("cast(substr(protein_id, 2) as int) % 2 = 0")
    proteins = again.select(F.concat(F.lit("alias"), F.substr("protein_id", F.lit(2)), F.lit("|new_"), "protein_id").alias("entry"), "sequence").unionByName(spark.createDataFrame([("fresh", "MMM")], "entry string, sequence string"))
    substrates = tables["substrates"].limit(0).unionByName(spark.createDataFrame([("fresh", "CC=O", [-1])], "name string, smiles string, fingerprint array<bigint>"))
    own = tables["domain_substrates"].groupBy("domain_id").agg(F.sort_array(F.collect_set("name")).alias("labels"))
    domains = tables["domains"].filter("cast(substr(domain_id, 2) as int) % 10 = 7").join(own, "domain_id")
    domains = domains.select(F.concat("domain_id", F.lit(".A1|new"), "domain_id").alias("entry"), "sequence", "signature", "extended_signature", "labels")
    out = None
    for name, rows in P.populated(tables, proteins, substrates, domains, on_equivalent="new").items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- SQL surface -----------------------------------------------------------------------------------------------------

@query("SELECT count(*) AS total FROM orders WHERE o_orderkey % 2 = 0")
def sql_total(spark, sf):
    return sqlsurface.sql_total(views(spark, sf, "orders"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")


@query("""SELECT CASE WHEN contains(a, ',') OR contains(a, '"') THEN '"' || replace(a, '"', '""') || '"' ELSE a END || ',' || c_nationkey AS value FROM (SELECT c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ', x' WHEN 1 THEN ' "y"' ELSE '' END AS a, c_nationkey FROM customer)""")
def export_lines(spark, sf):
    sql = """SELECT c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ', x' WHEN 1 THEN ' "y"' ELSE '' END AS a, c_nationkey FROM customer"""
    return sqlsurface.export_lines(sqlsurface.sql_export(views(spark, sf, "customer"), sql))


PRESET = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey"
SIGNED = "rpad(upper(left(replace(p_name, ' ', ''), 10)), 10, '-')"


@query(f"SELECT l_orderkey AS domain_id, min(hamming({SIGNED}, 'REDRING---')) AS distance, max(s_name) AS protein, min(c_name) AS synonym {PRESET} WHERE hamming({SIGNED}, 'REDRING---') <= 4 GROUP BY l_orderkey ORDER BY distance, domain_id LIMIT 500")
def by_signature(spark, sf):
    spark = views(spark, sf, "lineitem", "orders", "supplier", "part", "customer")
    S.register(spark)
    distance = "hamming10(replace(p_name, ' ', ''), 'redring')"
    return spark.sql(f"SELECT l_orderkey AS domain_id, min({distance}) AS distance, max(s_name) AS protein, min(c_name) AS synonym {PRESET} WHERE {distance} <= 4 GROUP BY l_orderkey ORDER BY distance, domain_id LIMIT 500")
