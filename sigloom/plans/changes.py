"""Queries for changes to the catalogue, over the same stand-ins as the catalogue's, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import etl
from sigloom.plans.catalogue import query, t


@query("""WITH known AS (SELECT * FROM part WHERE p_size > 25), incoming AS (SELECT * FROM part WHERE p_size <= 25),
  n AS (SELECT p_brand || '.' || p_type AS synonym, max(p_partkey) AS id FROM known WHERE p_type <> 'PROMO' GROUP BY 1), s AS (SELECT p_name AS sequence, min(p_partkey) AS id FROM known GROUP BY 1)
  SELECT p_partkey AS entry, coalesce(n.id, s.id) AS matched, CASE WHEN n.id IS NOT NULL THEN 'synonym' WHEN s.id IS NOT NULL THEN 'sequence' ELSE 'new' END AS how
  FROM incoming LEFT JOIN n ON p_brand || '.' || p_type = n.synonym LEFT JOIN s ON p_name = s.sequence""")
def match_entries(spark, sf):
    part = t(spark, sf, "part")
    known, incoming = part.filter("p_size > 25"), part.filter("p_size <= 25")
    names = known.filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_type").alias("synonym"))
    entries = incoming.select(F.col("p_partkey").alias("entry"), F.array(F.col("p_brand"), F.concat_ws(".", "p_brand", "p_type")).alias("synonyms"), F.col("p_name").alias("sequence"))
    return etl.match_entries(entries, names, known.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sequence")))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey AS domain_id, l_partkey AS label FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM c) UNION ALL SELECT l_orderkey, l_partkey FROM c""")
def corrections_apply(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("domain_id"), F.col("l_partkey").alias("label"), "l_returnflag")
    return etl.apply_corrections(lines, lines.filter("l_returnflag = 'R'"), t(spark, sf, "part").select(F.col("p_partkey").alias("label")))


@query("""WITH p AS (SELECT l_suppkey AS protein_id, l_orderkey AS domain_id, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY ALL)
  SELECT protein_id, domain_id, coalesce(low >= s_nationkey AND high <= s_nationkey + 30, false) AS found FROM p LEFT JOIN supplier ON s_suppkey = protein_id""")
def position_range_check(spark, sf):
    asked = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("protein_id"), F.col("l_orderkey").alias("domain_id")).agg(F.collect_list("l_quantity").alias("positions"))
    held = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("protein_id"), (F.col("s_nationkey") + 1).alias("start"), (F.col("s_nationkey") + 30).alias("end"))
    return etl.within_range(asked, held).drop("positions")


@query("""SELECT l_orderkey AS protein, l_suppkey AS synonym, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS labels
  FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus <> 'O' GROUP BY ALL""")
def annotations_cleanup(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "no_update").otherwise("correction")
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("protein"), F.col("l_suppkey").alias("synonym"), kind.alias("type"), F.col("l_partkey").cast("string").alias("label"), F.nullif("l_linestatus", F.lit("O")).alias("status"))
    return etl.clean_annotations(rows, ["label", "status"]).withColumn("labels", F.array_join("labels", "|"))


@query("""SELECT l_orderkey AS protein, l_returnflag AS type, CAST(to_json(list({'domain': l_linenumber, 'label': l_partkey} ORDER BY l_linenumber, l_partkey)) AS VARCHAR) AS body
  FROM lineitem GROUP BY ALL""")
def submission_json(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("protein"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("domain"), F.col("l_partkey").alias("label"))
    return etl.submissions(rows, ["domain", "label"])


@query("SELECT s_suppkey AS protein_id, n_nationkey AS taxon FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def taxonomy_link(spark, sf):
    nation, region = t(spark, sf, "nation"), t(spark, sf, "region")
    taxa = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("|", "n_name", "r_name").alias("key"), F.col("n_nationkey").alias("taxon"))
    proteins = t(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return etl.link_taxonomy(proteins.select(F.col("s_suppkey").alias("protein_id"), F.array("s_name", "n_name", "r_name").alias("synonyms")), taxa)


@query("""WITH o AS (SELECT l_suppkey AS protein_id, l_partkey AS domain_id, l_orderkey * 10 + l_linenumber AS s FROM lineitem), n AS (SELECT DISTINCT l_suppkey AS protein_id, l_partkey AS domain_id, l_quantity AS number FROM lineitem),
  p AS (SELECT *, row_number() OVER (PARTITION BY protein_id, domain_id ORDER BY s) AS nth, count(*) OVER (PARTITION BY protein_id, domain_id) AS places FROM (SELECT DISTINCT * FROM o)),
  m AS (SELECT *, row_number() OVER (PARTITION BY protein_id, domain_id ORDER BY number) AS nth, count(*) OVER (PARTITION BY protein_id, domain_id) AS names FROM n)
  SELECT protein_id, domain_id, CAST(CASE WHEN places = names THEN number END AS BIGINT) AS number, s AS "start" FROM p LEFT JOIN m USING (protein_id, domain_id, nth)""")
def occurrence_link(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("protein_id"), F.col("l_partkey").alias("domain_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"), F.col("l_quantity").alias("number"))
    return etl.link_occurrences(lines.drop("number").distinct(), lines).withColumn("number", F.col("number").cast("long"))


#: Fixed values of the query: what the words of a part's name stand for.
MEANINGS = {"cold": "chilled", "small": "little|tiny", "bolt": "fastener"}


@query("""WITH w AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ')) AS w FROM part), m AS (SELECT id, unnest(string_split(CASE w WHEN 'cold' THEN 'chilled' WHEN 'small' THEN 'little|tiny' WHEN 'bolt' THEN 'fastener' ELSE w END, '|')) AS w FROM w)
  SELECT id, string_agg(DISTINCT w, '|' ORDER BY w) AS labels FROM m GROUP BY id""")
def labels_mapped(spark, sf):
    labels = etl.mapped_labels(F.replace("p_name", F.lit(" "), F.lit("|")), MEANINGS)
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.split(labels, "[|]")), "|").alias("labels"))
