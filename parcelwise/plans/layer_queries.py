"""Queries over layers, fields, runs and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import crs, geometry, text
from parcelwise.operators import mapping, profile, results, territory
from parcelwise.plans.derived import PARCELS_SQL, parcels
from parcelwise.session import table
from parcelwise.sources import layers

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _cycle(key, values):
    """The value at key modulo the number of values."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _cycle_sql(key: str, values) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"([{listed}]::varchar[])[({key} % {len(values)} + 1)::int]"


@query("select doc_id, md5(text) as repaired from documents")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(text.repair_mojibake(broken)).alias("repaired"))


@query(r"select doc_id, md5(regexp_replace(strip_accents(lower(trim(text))), '[^\p{L}\p{N}]', '', 'g')) as key from documents")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("key"))


_BOOLS = ("Sim", "não", "TRUE", "0", "2", "abc", None, "No", " yes ", "-1.5", "0.0")


@query(f"""with r as (select event_id, {_cycle_sql('event_id', _BOOLS)} as raw from events)
select event_id, case when raw in ('Sim', 'TRUE', '2', ' yes ', '-1.5') then true when raw in ('não', '0', 'No', '0.0') then false end as value from r""")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.to_bool(_cycle(F.col("event_id"), _BOOLS)).alias("value"))


@query("""select p_partkey, case when p_partkey % 5 in (0, 1) then round(p_retailprice, 2) when p_partkey % 5 = 2 then -3 end::double as area, p_partkey % 5 = 3 as unreadable from part""")
def coerce_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(price, F.lit(" m²"))).when(F.col("p_partkey") % 5 == 1, price).when(F.col("p_partkey") % 5 == 2, "-3").when(F.col("p_partkey") % 5 == 3, F.concat(price, F.lit(" ha")))
    return table(spark, sf_dir, "part").select("p_partkey", text.to_area(raw).cast("double").alias("area"), text.area_unreadable(raw).alias("unreadable"))


_MACRO = ("LOTE", "Sistema Viário", "AVL", "app", "outra", None)
_USE = ("Residencial", "Comercial; Serviços", "(none)", "INDUSTRIAL", "comercial;Comercial")


@query(f"""select event_id, {_cycle_sql('event_id', ('lote', 'sistema_viario', 'avl', 'app', None, None))} as macroarea,
  {_cycle_sql('event_id', ('residencial', 'misto', None, 'industrial', 'comercial'))} as land_use,
  {_cycle_sql('event_id', _MACRO)} is not null as has_macro from events""")
def map_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    source = F.map_from_entries(F.filter(F.array(F.struct(F.lit("TIPO DE MACROÁREA").alias("key"), _cycle(key, _MACRO).alias("value")), F.struct(F.lit("Uso do solo").alias("key"), _cycle(key, _USE).alias("value"))), lambda e: e["value"].isNotNull()))
    mapped = mapping.map_attributes(table(spark, sf_dir, "events").select("event_id", source.alias("source")), {"macroarea": "TIPO DE MACROÁREA", "land_use": "Uso do solo"})
    return mapped.select("event_id", "macroarea", "land_use", F.map_contains_key("mapped", "macroarea").alias("has_macro"))


_FIELDS = ("Comments", "tipo de macroarea", "USO-DO-SOLO", "Name", "QUADRA", "quadra")
_ALIASES = {"macroarea": ("TIPO DE MACROÁREA", "Comments"), "land_use": ("Uso do solo",), "quadra_id": ("QUADRA",)}


@query(f"""with f as (select distinct p_partkey // 3 as layer_id, {_cycle_sql('p_partkey', _FIELDS)} as field from part)
select layer_id, 'macroarea' as target, max_by(field, field) as field from f where field in ('Comments', 'tipo de macroarea') group by layer_id
union all select layer_id, 'land_use', max(field) from f where field = 'USO-DO-SOLO' group by layer_id
union all select layer_id, 'quadra_id', max(field) from f where field in ('QUADRA', 'quadra') group by layer_id""")
def suggest_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).cast("bigint").alias("layer_id"), _cycle(F.col("p_partkey"), _FIELDS).alias("field")).distinct()
    return mapping.suggest_mapping(fields, _ALIASES)


def _both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Geometry and attribute rows of layers; some layers have blank, repeated or unmatched keys."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 8).cast("bigint").alias("layer_id"), F.col("o_orderkey").alias("feature_id"), "o_orderpriority")
    key = F.col("feature_id").cast("string")
    left = orders.select("layer_id", "feature_id", F.when(F.col("feature_id") % 1501 == 7, "").otherwise(key).alias("key"), F.create_map(F.lit("use"), F.lit("?"), F.lit("id"), key).alias("source"))
    right = orders.filter(F.col("feature_id") % 997 != 3).withColumn("copies", F.when(F.col("feature_id") % 1201 == 5, 2).otherwise(1))
    return left, right.select("layer_id", key.alias("key"), F.create_map(F.lit("use"), F.col("o_orderpriority")).alias("attributes"), F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")


_SIDES = """a as (select o_custkey // 8 as layer_id, o_orderkey as feature_id, case when o_orderkey % 1501 = 7 then '' else o_orderkey::varchar end as key from orders),
b as (select o_custkey // 8 as layer_id, o_orderkey::varchar as key, o_orderpriority as use from orders, range(2) as r(i) where o_orderkey % 997 <> 3 and (i = 0 or o_orderkey % 1201 = 5)),
v as (select distinct layer_id, key, 'geometry' as side, 'empty_key' as fault from a where key = ''
  union all select layer_id, key, 'geometry', 'duplicate_key' from a where key <> '' group by layer_id, key having count(*) > 1
  union all select distinct layer_id, key, 'geometry', 'unmatched_key' from a where key <> '' and (layer_id, key) not in (select layer_id, key from b)
  union all select layer_id, key, 'attribute', 'duplicate_key' from b group by layer_id, key having count(*) > 1
  union all select distinct layer_id, key, 'attribute', 'unmatched_key' from b where (layer_id, key) not in (select layer_id, key from a))"""


@query(f"with {_SIDES} select layer_id, feature_id, use from a join b using (layer_id, key) where layer_id not in (select layer_id from v)")
def attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.join_attributes(*_both_sides(spark, sf_dir)).select("layer_id", "feature_id", F.col("source")["use"].alias("use"))


@query(f"with {_SIDES} select * from v")
def attribute_join_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.join_faults(*_both_sides(spark, sf_dir))


@query(f"""with {_SIDES} select layer_id, coalesce(n_geometry, 0) as n_geometry, coalesce(n_attribute, 0) as n_attribute, coalesce(n_matched, 0) as n_matched
from (select layer_id, count(*) as n_geometry from a group by 1) full join (select layer_id, count(*) as n_attribute from b group by 1) using (layer_id)
left join (select layer_id, count(distinct key) as n_matched from a join b using (layer_id, key) group by 1) using (layer_id)""")
def attribute_join_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.join_summary(*_both_sides(spark, sf_dir))


def _event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    source = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")), F.lit("mixed"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.lit("abc")), F.lit("fixed"), F.lit("7")))
    return events.select(F.pmod("user_id", F.lit(40)).alias("layer_id"), F.col("event_id").alias("feature_id"), source.alias("source"))


_FIELDS_SQL = """f as (select user_id % 40 as layer_id, event_id as feature_id, unnest([
    {'field': 'k', 'value': json_extract_string(props, '$.k')}, {'field': 'kind', 'value': case when event_id % 9 = 0 then ' ' else event_type end},
    {'field': 'mixed', 'value': case when event_id % 2 = 0 then user_id::varchar else 'abc' end}, {'field': 'fixed', 'value': '7'}], recursive := true) from events),
g as (select *, case when trim(value) <> '' then value end as filled from f),
s as (select layer_id, field, count(*) as present_count, count(*) - count(filled) as empty_count, count(distinct filled) as cardinality,
  count(case when regexp_full_match(filled, '-?[0-9]+(\\.[0-9]+)?') then 1 end) as numeric_count,
  min(case when regexp_full_match(filled, '-?[0-9]+(\\.[0-9]+)?') then filled::double end) as numeric_min,
  max(case when regexp_full_match(filled, '-?[0-9]+(\\.[0-9]+)?') then filled::double end) as numeric_max from g group by layer_id, field)"""


@query(f"with {_FIELDS_SQL} select * from s")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_stats(_event_fields(spark, sf_dir))


@query(f"with {_FIELDS_SQL} select layer_id, field, value, row_number() over (partition by layer_id, field order by value) as rank from (select distinct layer_id, field, value from g where filled is not null) join s using (layer_id, field) where cardinality <= 33")
def field_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_values(_event_fields(spark, sf_dir)).select("layer_id", "field", "value", F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {_FIELDS_SQL}, m as (select *, present_count - empty_count as filled from s)
select layer_id, field, case when filled <= 0 then 'empty' when numeric_count = filled then 'numeric' when numeric_count > 0 then 'mixed' else 'text' end as kind,
  case when filled <= 0 then null when numeric_count = filled then case when cardinality = 1 then 'single' else 'sequential' end when numeric_count > 0 or cardinality > 32 then null else 'categorical' end as mode,
  case when filled <= 0 then 'field_empty' when numeric_count = filled then null when numeric_count > 0 then 'mixed_types' when cardinality > 32 then 'categorical_cardinality_exceeded' end as reason from m""")
def field_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_mode(profile.field_stats(_event_fields(spark, sf_dir)))


@query(f"""with {_FIELDS_SQL}, r as (select layer_id, feature_id, row_number() over (partition by layer_id order by feature_id) as n from (select distinct layer_id, feature_id from f))
select layer_id, field, array_to_string(list_sort(list(distinct value))[1:5], '|') as sample from g join r using (layer_id, feature_id) where n <= 20 and filled is not null group by layer_id, field""")
def field_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_sample(_event_fields(spark, sf_dir)).withColumn("sample", F.array_join("sample", "|"))


@query(f"""with {PARCELS_SQL}, s as (select project_id as layer_id, unnest([
  {{'field': 'macroarea', 'present_count': count(macroarea), 'cardinality': count(distinct macroarea), 'numeric_min': null::double, 'numeric_max': null::double}},
  {{'field': 'land_use', 'present_count': count(land_use), 'cardinality': count(distinct land_use), 'numeric_min': null, 'numeric_max': null}},
  {{'field': 'ca_max', 'present_count': count(ca_max), 'cardinality': null, 'numeric_min': min(ca_max), 'numeric_max': max(ca_max)}},
  {{'field': 'parcelavel', 'present_count': count(parcelavel), 'cardinality': count(distinct parcelavel), 'numeric_min': null, 'numeric_max': null}}], recursive := true) from parcels group by project_id)
select * from s where present_count > 0""")
def mapped_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).withColumnRenamed("project_id", "layer_id")
    return profile.mapped_stats(rows, ("macroarea", "land_use"), ("ca_max",), ("parcelavel",))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), status.alias("status"), "value")


_RUNS = "runs as (select user_id as project_id, event_id as run_id, ts as created_at, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status, value from events)"
_LATEST = "latest as (select project_id, max_by(run_id, (created_at, run_id)) as run_id from runs where status = 'completed' group by project_id)"


@query(f"with {_RUNS}, {_LATEST} select * from latest")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.latest_run(_runs(spark, sf_dir)).select("project_id", "run_id")


@query(f"with {_RUNS} select project_id, run_id, row_number() over (partition by project_id order by created_at desc, run_id desc) as position from runs")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.run_history(_runs(spark, sf_dir)).select("project_id", "run_id", F.col("position").cast("bigint").alias("position"))


@query(f"with {_RUNS}, {_LATEST} select run_id, project_id, round(value, 4) as value from runs join latest using (project_id, run_id)")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return results.latest_results(runs.drop("value"), runs.select("run_id", F.round("value", 4).alias("value")))


@query("select user_id as project_id, max_by(event_id, (ts, event_id)) as version_id from events group by user_id")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.current_version(_runs(spark, sf_dir).withColumnRenamed("run_id", "version_id")).select("project_id", "version_id")


_LOTS = f"with {PARCELS_SQL}"


@query(f"""{_LOTS}, u as (select project_id, land_use as key, sum(area) as v from areas where macroarea = 'lote' and land_use is not null group by all)
select project_id, key, round(v / sum(v) over (partition by project_id), 6) as share, row_number() over (partition by project_id order by v desc, key) as position from u""")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.category_shares(territory.land_use_area(parcels(spark, sf_dir))).select("project_id", "key", F.round("share", 6).alias("share"), F.col("position").cast("bigint").alias("position"))


@query(f"{_LOTS} select project_id, count(*) as n, min(area) as low, max(area) as high, round(avg(area), 6) as mean from areas group by project_id")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = territory.measured(parcels(spark, sf_dir)).select("project_id", F.col("area").alias("value"))
    return results.distribution_summary(values).withColumn("mean", F.round("mean", 6))


@query(f"{_LOTS} select project_id, quadra_id as key, min(d) as shallow, max(d) as deep from parcels group by all")
def compound_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).select("project_id", F.col("quadra_id").alias("key"), (geometry.bounds(F.col("geom"))["y1"] - geometry.bounds(F.col("geom"))["y0"]).alias("d"))
    long = rows.groupBy("project_id", "key").agg(F.min("d").alias("shallow"), F.max("d").alias("deep"))
    long = long.select("project_id", "key", F.explode(F.map_from_arrays(F.array(F.lit("shallow"), F.lit("deep")), F.array("shallow", "deep"))).alias("sub_field", "value"))
    return results.compound_pivot(long, ["shallow", "deep"])


@query("""with v as (select c_nationkey as key, c_acctbal + 1000.0 as value from customer), r as (select key, min(value) as low, max(value) as high from v group by key)
select key, 'quantile' as scale, k::int as class, round(q, 4) as break from (select key, unnest([1, 2, 3]) as k, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) as q from v group by key)
union all select key, 'linear', k::int, round(low + (high - low) * k / 4, 4) from r, (values (1), (2), (3)) as c(k)
union all select key, 'sqrt', k::int, round(power(sqrt(low) + (sqrt(high) - sqrt(low)) * k / 4, 2), 4) from r, (values (1), (2), (3)) as c(k)
union all select key, 'log', k::int, round(exp(ln(low) + (ln(high) - ln(low)) * k / 4), 4) from r, (values (1), (2), (3)) as c(k)
union all select key, 'threshold', k::int, [100.0, 500.0][k::int]::double from r, (values (1), (2)) as c(k)""")
def class_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), (F.col("c_acctbal") + 1000.0).alias("value"))
    out = None
    for scale in ("quantile", "linear", "sqrt", "log", "threshold"):
        part = profile.class_breaks(values, scale, 4, (100.0, 500.0)).select("key", F.lit(scale).alias("scale"), F.col("class").cast("int").alias("class"), F.round("break", 4).alias("break"))
        out = part if out is None else out.unionByName(part)
    return out


_THEMES = [("territorial", "perimetro"), ("territorial", "territorio"), ("road_network", "sistema_viario"), ("road_network", "perimetro")]


@query("""with n as (select * from (values ('territorial', 'perimetro'), ('territorial', 'territorio'), ('road_network', 'sistema_viario'), ('road_network', 'perimetro')) as t(theme, layer_type)),
l as (select o_orderkey // 3 as project_id, (['perimetro', 'territorio', 'sistema_viario'])[(o_orderkey % 3 + 1)::int] as layer_type, case o_orderstatus when 'F' then 'mapped' when 'O' then 'uploaded' else 'error' end as status from orders where o_custkey % 10 <> 0)
select p.project_id, theme, (['available', 'attention', 'blocked'])[max(case when status is null or status = 'error' then 2 when status = 'uploaded' then 1 else 0 end) + 1] as readiness
from (select distinct o_orderkey // 3 as project_id from orders) p, n left join l on l.project_id = p.project_id and l.layer_type = n.layer_type group by all""")
def theme_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("project_id", F.floor(F.col("o_orderkey") / 3).cast("bigint"))
    status = F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("error")
    has = orders.filter(F.col("o_custkey") % 10 != 0).select("project_id", _cycle(F.col("o_orderkey"), ("perimetro", "territorio", "sistema_viario")).alias("layer_type"), status.alias("status"))
    return results.theme_readiness(orders.select("project_id").distinct(), _THEMES, has)


@query(f"""{_LOTS}, s as (select distinct project_id from parcels where project_id % 3 <> 0)
select p.project_id, p.feature_id, i.code as indicator_code, case when i.code = 'lots.frontage_length' and s.project_id is not null and p.macroarea = 'lote' then 'available' when s.project_id is not null then 'no_data' else 'not_calculated' end as status
from parcels p cross join (values ('lots.frontage_length'), ('lots.distance_to_green_area')) as i(code) left join s on s.project_id = p.project_id""")
def feature_indicator_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).withColumn("layer_type", F.lit("territorio"))
    catalog = spark.createDataFrame([("lots.frontage_length", "territorio", "feature_id"), ("lots.distance_to_green_area", "territorio", "feature_id")], "indicator_code string, layer_type string, feature_key string")
    ran_projects = rows.filter("project_id % 3 <> 0")
    values = ran_projects.filter("macroarea = 'lote'").select("project_id", F.lit("lots.frontage_length").alias("indicator_code"), F.col("feature_id").cast("string").alias("key"), F.lit(1.0).alias("value"))
    ran = ran_projects.select("project_id").distinct().withColumn("indicator_code", F.explode(F.array(F.lit("lots.frontage_length"), F.lit("lots.distance_to_green_area"))))
    return results.feature_indicator_status(rows, catalog, values, ran)


@query(f"""with {_FIELDS_SQL}, m as (select layer_id, field, case when numeric_count = present_count - empty_count then case when cardinality = 1 then 'single' else 'sequential' end when numeric_count > 0 or cardinality > 32 then null else 'categorical' end as good from s),
y as (select event_id as style_id, event_id % 45 as layer_id, {_cycle_sql('event_id', ('k', 'kind', 'mixed', 'gone'))} as field, {_cycle_sql('event_id', ('sequential', 'categorical', 'single'))} as mode from events),
j as (select y.*, l.layer_id is not null as has_layer, m.field is not null as has_field, good from y left join (select distinct layer_id from s) l on l.layer_id = y.layer_id left join m on m.layer_id = y.layer_id and m.field = y.field)
select style_id, layer_id, field, case when not has_layer then 'layer_missing' when not has_field then 'field_missing' else 'mode_unsuitable' end as fault from j
where not has_layer or not has_field or good is null or (mode <> good and mode <> 'single')""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.field_stats(_event_fields(spark, sf_dir))
    key = F.col("event_id")
    styles = table(spark, sf_dir, "events").select(key.alias("style_id"), (key % 45).alias("layer_id"), _cycle(key, ("k", "kind", "mixed", "gone")).alias("field"), _cycle(key, ("sequential", "categorical", "single")).alias("mode"))
    return results.integrity_report(styles, stats, stats.select("layer_id").distinct(), profile.field_mode(stats))


@query(f"{_LOTS}, b as (select project_id, quadra_id, count(*) as n from parcels where macroarea = 'lote' group by all) select project_id, quadra_id, feature_id, n::double as value from parcels join b using (project_id, quadra_id)")
def result_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    values = rows.filter("macroarea = 'lote'").groupBy("project_id", F.col("quadra_id").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return results.result_overlay(rows.select("project_id", "quadra_id", "feature_id"), values, "quadra_id")


_TYPES = ("Polygon", "MultiPolygon", "Polygon", "LineString", "Polygon", "Polygon", "Polygon")


@query(f"""with l as (select event_id // 4 as layer_id, {_cycle_sql('event_id // 4', ('lotes', 'sistema_viario', 'quadras'))} as layer_type, list_sort(list(distinct {_cycle_sql('event_id', _TYPES)})) as kinds from events group by all)
select layer_id, layer_type, case when len(kinds) > 1 then 'mixed_geometry' else 'geometry_not_allowed' end as fault from l
where len(kinds) > 1 or (layer_type = 'sistema_viario' and kinds[1] <> 'LineString') or (layer_type <> 'sistema_viario' and kinds[1] = 'LineString')""")
def layer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    layer = F.floor(key / 4).cast("bigint")
    rows = table(spark, sf_dir, "events").select(layer.alias("layer_id"), _cycle(layer, ("lotes", "sistema_viario", "quadras")).alias("layer_type"), _cycle(key, _TYPES).alias("geom_type"))
    return layers.contract_faults(rows).select("layer_id", "layer_type", "fault")


@query("select user_id as version_id, event_type as layer_type, count(*) as n_layers from events group by all having count(*) > 1")
def duplicate_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.duplicate_layers(table(spark, sf_dir, "events").select(F.col("user_id").alias("version_id"), F.col("event_type").alias("layer_type")))


@query("""with p as (select distinct user_id as project_id from events), l as (select distinct user_id as project_id, case when event_type = 'view' and user_id % 3 <> 0 then 'perimetro' when event_type = 'click' and user_id % 4 <> 0 then 'territorio' else 'lotes' end as layer_type from events)
select project_id, t as layer_type from p, (values ('perimetro'), ('territorio')) as n(t) where (project_id, t) not in (select project_id, layer_type from l)""")
def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 != 0), "perimetro").when((F.col("event_type") == "click") & (F.col("user_id") % 4 != 0), "territorio").otherwise("lotes")
    has = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), kind.alias("layer_type")).distinct()
    return layers.missing_layers(has.select("project_id").distinct(), has, ["territorio"])


@query(
    _LOTS
    + """, t as (select *, x0::double::varchar as a, y0::double::varchar as b, (x0 + w)::double::varchar as c, (y0 + d)::double::varchar as e from parcels)
select project_id as layer_id, feature_id, '{"type":"Feature","id":"' || feature_id || '","geometry":{"type":"Polygon","coordinates":[[[' || a || ',' || b || '],[' || c || ',' || b || '],[' || c || ',' || e || '],[' || a || ',' || e || '],[' || a || ',' || b
  || ']]]},"properties":{"macro":' || coalesce('"' || macroarea || '"', 'null') || ',"quadra":"' || quadra_id || '"}}' as feature from t"""
)
def export_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir).withColumn("layer_id", F.col("project_id")).withColumn("source", F.create_map(F.lit("macro"), F.col("macroarea"), F.lit("quadra"), F.lit("?"))).withColumn("mapped", F.create_map(F.lit("quadra"), F.col("quadra_id")))
    return layers.export_geojson(rows)


@query(f"{_LOTS} select project_id, feature_id, round(geometric, 6) as area, round(20 + 2 * d, 6) as length from parcels")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels(spark, sf_dir).select("project_id", "feature_id", F.round(geometry.area(F.col("geom")), 6).alias("area"), F.round(geometry.length(F.col("geom")), 6).alias("length"))


@query(f"{_LOTS} select project_id, min(x0) as x0, min(y0) as y0, max(x0 + w) as x1, max(y0 + d) as y1 from parcels group by project_id")
def project_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geometry.bounds(F.col("geom"))
    return parcels(spark, sf_dir).select("project_id", b.alias("b")).groupBy("project_id").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def _lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key, F.floor(key / 5).cast("bigint").alias("project_id"), (F.lit(-60.0) + F.floor(key / 5) % 12 + key % 10 / 8.0).alias("lon"), (F.lit(-30.0) + key % 17).alias("lat"))


_LONLAT = "c as (select c_custkey, c_custkey // 5 as project_id, -60.0 + (c_custkey // 5) % 12 + c_custkey % 10 / 8.0 as lon, -30.0 + c_custkey % 17 as lat from customer)"


@query(f"""with {_LONLAT}, e as (select project_id, min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from c group by project_id),
z as (select *, 32700 + least(floor(((x0 + x1) / 2 + 180) / 6)::int + 1, 60) as zone from e)
select project_id, case when x0 >= -54 and x1 <= -48 and y1 <= 0 then 32722 when x0 >= (zone % 100) * 6 - 186 and x1 <= (zone % 100) * 6 - 180 and y1 <= 0 then zone end as epsg from z""")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = _lonlat(spark, sf_dir).groupBy("project_id").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    return extent.select("project_id", crs.select_epsg(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("int").alias("epsg"))


def _kruger_sql() -> str:
    """The projection again, in SQL, from the same constants."""
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in enumerate(crs._ALPHA, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in enumerate(crs._ALPHA, 1))])
    scale = crs.SCALE * crs._A
    return f"""with {_LONLAT}, z as (select *, floor((lon + 180) / 6)::int + 1 as zone from c),
a as (select c_custkey, 32700 + zone as epsg, radians(lat) as phi, radians(lon - (zone * 6 - 183)) as lam from z),
t as (select *, atanh(sin(phi)) - {crs._E!r} * atanh({crs._E!r} * sin(phi)) as q from a),
u as (select *, (exp(q) - exp(-q)) / 2 as t from t), v as (select c_custkey, epsg, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from u)
select c_custkey, epsg, round({scale!r} * ({east}) + 500000, 4) as x, round({scale!r} * ({north}) + 10000000, 4) as y from v"""


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in the zone that its own degrees lie in."""
    rows = _lonlat(spark, sf_dir).withColumn("epsg", crs.utm_epsg(F.col("lon"), F.col("lat")))
    return rows.withColumn("p", crs.to_utm(F.col("lon"), F.col("lat"), F.col("epsg")))


@query(_kruger_sql())
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir).select("c_custkey", "epsg", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(f"with {_LONLAT} select c_custkey, round(lon, 7) as lon, round(lat, 7) as lat from c")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _projected(spark, sf_dir).withColumn("q", crs.from_utm(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    return back.select("c_custkey", F.round("q.x", 7).alias("lon"), F.round("q.y", 7).alias("lat"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
