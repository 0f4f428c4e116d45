"""The catalogue queries, each with its SQL where SQL can express it.

All read the test tables: items come from the catalogue view over them, and coordinates, seeds and requests are
derived from their rows. Similarities are rounded on output only; orders use the full values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions import noise, scalars
from vecatlas.operators import catalogue, components, field, fusion, ingest, knn, knn_join, requests, seen, telemetry, vector_index
from vecatlas.sources import parts, stores, work
from vecatlas.sources.artworks import CTE, SCHEMA, from_test_tables, violations
from vecatlas.streaming import downloads

TARGET, SECOND, TARGETS = 3, 5, (3, 5, 6, 10)
ELIGIBLE = "imgVec IS NOT NULL AND localImageUrl IS NOT NULL AND localImageUrl <> ''"
URL = "coalesce(nullif(localImageUrl, ''), nullif(primaryImageSmall, ''), nullif(primaryImage, ''))"
SOURCE = "CASE WHEN localImageUrl <> '' THEN 's3' WHEN primaryImageSmall <> '' THEN 'met_small' WHEN primaryImage <> '' THEN 'met_original' END"
DIMENSION = 64
FOUND: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query (spark, artworks, read) under its function's name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, from_test_tables(spark, sf_dir), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        FOUND[f.__name__] = (run, f"WITH RECURSIVE {CTE}{sql}" if sql and sql.startswith(",") else f"WITH {CTE}\n{sql}" if sql else None)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("similarity",)})


def stored_vector(artworks: DataFrame, item: int) -> list[float]:
    return catalogue.target(artworks, item)["imgVec"]


def stored_vectors(artworks: DataFrame, items) -> list[list[float]]:
    return [row["imgVec"] for row in catalogue.targets(artworks, list(items))]


def stored_basis(artworks: DataFrame) -> list[list[float]]:
    return stored_vectors(artworks, (TARGET, SECOND))


def sim_sql(item: int) -> str:
    return f"list_cosine_similarity(imgVec, (SELECT imgVec FROM artworks WHERE id = {item}))"


# Filters, projections, lists


@query(f"SELECT count(*) AS n FROM artworks WHERE {ELIGIBLE}")
def eligible_count(spark, artworks, read):
    return artworks.where(catalogue.eligible()).agg(F.count("*").alias("n"))


@query(f'SELECT id, {URL} AS "imageUrl", {SOURCE} AS "imageSource", primaryImage AS "originalImageUrl" FROM artworks')
def image_url_priority(spark, artworks, read):
    return artworks.select("id", catalogue.image_url().alias("imageUrl"), catalogue.image_source().alias("imageSource"), F.col("primaryImage").alias("originalImageUrl"))


@query(f"SELECT id, title, artist FROM artworks WHERE id = {TARGET} AND {ELIGIBLE}")
def target_lookup(spark, artworks, read):
    return artworks.where((F.col("id") == TARGET) & catalogue.eligible()).limit(1).select("id", "title", "artist")


@query('SELECT id, objectId AS "objectId", title, artist, department FROM artworks ORDER BY id LIMIT 10')
def legacy_list(spark, artworks, read):
    return catalogue.first_items(artworks).select("id", "objectId", "title", "artist", "department")


@query(f"""SELECT id, objectId AS "objectId", title, artist, "date", department, creditLine AS "creditLine", description, {URL} AS "imageUrl",
  primaryImage AS "originalImageUrl", {SOURCE} AS "imageSource", objectUrl AS "objectUrl", true AS "hasEmbedding"
FROM artworks WHERE {ELIGIBLE} ORDER BY md5(concat(id, ':', 42)), id LIMIT 200""")
def random_sample(spark, artworks, read):
    return catalogue.random_sample(artworks, 42, 200).data


@query(f"""SELECT to_json({{'id': id, 'imageUrl': {URL}}}) AS "json" FROM artworks WHERE {ELIGIBLE} ORDER BY md5(concat(id, ':', 7)), id LIMIT 50""")
def response_json(spark, artworks, read):
    found = catalogue.random_sample(artworks, 7, 50)
    return catalogue.Response(found.data.select("id", "imageUrl"), found.meta).as_json()


@query("""SELECT event_id, least(greatest(coalesce(nullif(try_cast(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0), 20), 1), 50) AS n
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN '0' ELSE concat(' -', event_id) END AS v FROM events)""")
def request_counts(spark, artworks, read):
    e = F.col("event_id") % 4
    given = F.when(e == 0, F.col("value").cast("string")).when(e == 1, F.col("event_type")).when(e == 2, "0").otherwise(F.concat(F.lit(" -"), F.col("event_id").cast("string")))
    return read("events").select("event_id", catalogue.clamp(given, 20, 1, 50).alias("n"))


@query(f"SELECT department, count(*) AS n FROM artworks WHERE {ELIGIBLE} GROUP BY department")
def facet_counts(spark, artworks, read):
    return catalogue.facets(artworks)


@query(f""", dirty AS (SELECT id, department, "date", imgVec FROM artworks UNION ALL
  SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE id END, CASE WHEN id % 2 = 0 THEN repeat('x', 301) ELSE department END, repeat('d', CAST(190 + id % 20 AS INTEGER)), imgVec[1 : 64 - id % 4] FROM artworks WHERE id % 5 = 0)
SELECT * FROM (SELECT 'department longer than 300' AS rule, count(*) FILTER (length(department) > 300) AS n FROM dirty UNION ALL SELECT 'date longer than 200', count(*) FILTER (length("date") > 200) FROM dirty
  UNION ALL SELECT 'id is null', count(*) FILTER (id IS NULL) FROM dirty UNION ALL SELECT 'imgVec not of dimension 64', count(*) FILTER (len(imgVec) <> 64) FROM dirty
  UNION ALL SELECT 'id repeated', count(*) FROM (SELECT id FROM dirty WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) WHERE n > 0""")
def catalogue_violations(spark, artworks, read):
    """The catalogue with some of its rows again, each spoilt in some way."""
    i = F.col("id")
    spoilt = artworks.where(i % 5 == 0).withColumns({
        "department": F.when(i % 2 == 0, F.repeat(F.lit("x"), 301)).otherwise(F.col("department")), "date": F.repeat(F.lit("d"), (190 + i % 20).cast("int")),
        "imgVec": F.slice("imgVec", F.lit(1), (64 - i % 4).cast("int")), "id": F.when(i % 3 == 0, None).otherwise(i),
    })
    return violations(artworks.unionByName(spoilt), DIMENSION)


@query("SELECT id, round(list_sum(list_transform(imgVec, lambda x: x * x)), 4) AS squares FROM artworks WHERE imgVec IS NOT NULL")
def vector_text_round_trip(spark, artworks, read):
    text = artworks.where("imgVec is not null").select("id", stores.vector_to_text("imgVec").alias("text"))
    v = stores.vector_from_text("text")
    return text.select("id", F.round(scalars.dot(v, v), 4).alias("squares"))


# Nearest items


@query(f"""SELECT id, objectId AS "objectId", title, artist, {URL} AS "imageUrl", primaryImage AS "originalImageUrl", {SOURCE} AS "imageSource", id = {TARGET} AS original, round(sim, 6) AS similarity
FROM (SELECT *, {sim_sql(TARGET)} AS sim FROM artworks WHERE {ELIGIBLE}) ORDER BY sim DESC, id LIMIT 160""")
def similar_artworks(spark, artworks, read):
    return rounded(knn.similar(artworks, TARGET).data)


@query(f"""SELECT id, round(sim, 6) AS similarity FROM (SELECT id, {sim_sql(TARGET)} AS sim FROM artworks WHERE {ELIGIBLE} AND id <> {TARGET} AND id NOT IN (5, 6, 10, 17, 20, 26)) ORDER BY sim DESC, id LIMIT 100""")
def knn_exclude_before(spark, artworks, read):
    return rounded(knn.nearest_without(artworks, TARGET, 100, [5, 6, 10, 17, 20, 26], after=False))


@query(f"""SELECT id, round(sim, 6) AS similarity FROM (SELECT id, {sim_sql(TARGET)} AS sim FROM artworks WHERE {ELIGIBLE} AND id <> {TARGET} ORDER BY sim DESC, id LIMIT 100)
WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""")
def knn_exclude_after(spark, artworks, read):
    excluded = read("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("int").alias("id"))
    return rounded(knn.nearest_without(artworks, TARGET, 100, excluded, after=True))


@query(f"""SELECT query, rank, id, round(sim, 6) AS similarity FROM (
  SELECT q.query, a.id, list_cosine_similarity(a.imgVec, q.imgVec) AS sim, row_number() OVER (PARTITION BY q.query ORDER BY list_cosine_similarity(a.imgVec, q.imgVec) DESC, a.id) AS rank
  FROM artworks a, (SELECT list_position([{', '.join(map(str, TARGETS))}], id) - 1 AS query, imgVec FROM artworks WHERE id IN {TARGETS}) q WHERE {ELIGIBLE.replace("imgVec", "a.imgVec")}) WHERE rank <= 10""")
def knn_per_chunk(spark, artworks, read):
    vectors = stored_vectors(artworks, TARGETS)
    return rounded(knn.nearest_of_many(artworks.where(catalogue.eligible()), vectors, [10] * len(vectors)).select("query", "rank", F.col("id").cast("int").alias("id"), "similarity"))


@query(f"""SELECT id, round(sim, 6) AS similarity FROM (SELECT id, {sim_sql(TARGET)} AS sim FROM artworks WHERE {ELIGIBLE} ORDER BY sim DESC, id LIMIT 50) WHERE sim >= 0.15""")
def search_threshold(spark, artworks, read):
    vector = stored_vector(artworks, TARGET)
    return rounded(knn.search(artworks, "a stored item", lambda text: vector, 50, 0.15).select("id", "similarity"))


EVERY_HUNDREDTH = "id % 100 = 0"  # a stated set of queries, each against all rows


@query()
def similar_indexed(spark, artworks, read):
    index = vector_index.build(artworks, work.folder(spark))
    asked = artworks.where(catalogue.eligible() & F.expr(EVERY_HUNDREDTH)).select(F.col("id").cast("long").alias("query"), F.col("imgVec").alias("vector"))
    return rounded(vector_index.search(spark, index, asked, 160))


@query(f"""SELECT CAST(q.id AS BIGINT) AS query, CAST(a.id AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(a.imgVec, q.imgVec) DESC, a.id) AS INTEGER) AS rank,
  round(list_cosine_similarity(a.imgVec, q.imgVec), 6) AS similarity
FROM (SELECT * FROM artworks WHERE {ELIGIBLE}) a, (SELECT * FROM artworks WHERE {ELIGIBLE} AND {EVERY_HUNDREDTH}) q QUALIFY rank <= 20""")
def knn_join_all(spark, artworks, read):
    items = artworks.where(catalogue.eligible()).select("id", "imgVec")
    return rounded(knn_join.knn_join(items.where(EVERY_HUNDREDTH), items, 20)[0])


# The field: coordinates, hashing, the stream, the bias

PLACES = "SELECT event_id, CAST(user_id % 25 - 12 AS DOUBLE) AS x, CAST(event_id % 25 - 12 AS DOUBLE) AS y FROM events"


def places(read):
    return read("events").select("event_id", (F.col("user_id") % 25 - 12).cast("double").alias("x"), (F.col("event_id") % 25 - 12).cast("double").alias("y"))


@query(f""", places AS ({PLACES}), near AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(y, x) AS theta, least(1.0, greatest(0.0, (sqrt(x * x + y * y) - 1.5) / 10.5)) AS s FROM places),
warm AS (SELECT *, s * s * (3 - 2 * s) AS t FROM near)
SELECT event_id, round(r, 9) AS r, round(theta, 9) AS theta, round(t, 9) AS t, round((1 - t) * (1 - t), 9) AS w_sim, round(2 * t * (1 - t), 9) AS w_drift, round(t * t, 9) AS w_rand, round(0.05 + 0.3 * t, 9) AS sigma,
  floor(theta * 100 + 0.5) / 100 AS theta_shown FROM warm""")
def field_coords(spark, artworks, read):
    p = places(read).withColumn("r", scalars.radius(F.col("x"), F.col("y"))).withColumn("theta", F.atan2("y", "x")).withColumn("t", scalars.temperature(F.col("r")))
    w = scalars.weights(F.col("t"))
    own = {"r": F.col("r"), "theta": F.col("theta"), "t": F.col("t"), "w_sim": w[0], "w_drift": w[1], "w_rand": w[2], "sigma": scalars.sigma(F.col("t"))}
    return p.select("event_id", *[F.round(c, 9).alias(k) for k, c in own.items()], scalars.half_up(F.col("theta"), 2).alias("theta_shown"))


HASH = "list_reduce([CAST(2166136261 AS BIGINT), {}], lambda h, n: (xor(h, n & 4294967295) * 16777619) & 4294967295)"


@query(f""", places AS ({PLACES})
SELECT event_id, {HASH.format("3, CAST(x AS BIGINT), CAST(y AS BIGINT), event_id")} AS hash, CASE WHEN sqrt(x * x + y * y) < 2 THEN {HASH.format("CAST(x AS BIGINT) + 100, CAST(y AS BIGINT) + 100")} % 50 ELSE 0 END AS skipped FROM places""")
def hash32_grid(spark, artworks, read):
    x, y = F.col("x"), F.col("y")
    skipped = F.when(scalars.radius(x, y) < 2, scalars.hash32(x + 100, y + 100) % 50).otherwise(0)
    return places(read).select("event_id", scalars.hash32(F.lit(TARGET), x, y, F.col("event_id")).alias("hash"), skipped.alias("skipped"))


def _product(a: str, b: str) -> str:
    return f"((({a}) * (({b}) & 65535) + (((({a}) * (({b}) >> 16)) & 65535) << 16)) & 4294967295)"


#: DuckDB steps of the pseudo-random stream from a relation "wanted" with seed and i.
STREAM = f"""s1 AS (SELECT *, (CAST(seed AS BIGINT) + CAST(i AS BIGINT) * 1831565813) & 4294967295 AS t FROM wanted),
s2 AS (SELECT *, {_product("xor(t, t >> 15)", "t | 1")} AS r FROM s1),
s3 AS (SELECT *, xor(r, (r + {_product("xor(r, r >> 7)", "r | 61")}) & 4294967295) AS q FROM s2),
draws AS (SELECT * EXCLUDE (t, r, q), xor(q, q >> 14) / 4294967296.0 AS u FROM s3)"""


@query(f""", wanted AS (SELECT event_id AS seed, i FROM events, (SELECT unnest(range(1, 9)) AS i)), {STREAM} SELECT seed, CAST(i AS INTEGER) AS i, CAST(u AS DOUBLE) AS u FROM draws""")
def prng_stream(spark, artworks, read):
    wanted = read("events").select(F.col("event_id").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
    return wanted.select("seed", "i", scalars.stream_draw(F.col("seed"), F.col("i")).alias("u"))


@query(f""", wanted AS (SELECT event_id AS seed, i FROM events, (SELECT unnest(range(1, 9)) AS i)), {STREAM}
SELECT seed, CAST((i - 1) // 2 AS INTEGER) AS j, round(sqrt(-2 * ln(max(u) FILTER (i % 2 = 1))) * cos(2 * pi() * max(u) FILTER (i % 2 = 0)), 9) AS g FROM draws GROUP BY seed, (i - 1) // 2""")
def gaussian_stream(spark, artworks, read):
    wanted = read("events").select(F.col("event_id").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    return wanted.select("seed", "j", F.round(scalars.normal_draw(F.col("seed"), F.col("j")), 9).alias("g"))


@query(f""", basis AS (SELECT a.imgVec AS u1, b.imgVec AS u2 FROM artworks a, artworks b WHERE a.id = {TARGET} AND b.id = {SECOND}),
placed AS (SELECT id, imgVec, CAST(id % 25 - 12 AS DOUBLE) AS x, CAST(objectId % 23 - 11 AS DOUBLE) AS y FROM artworks WHERE {ELIGIBLE}),
warm AS (SELECT *, atan2(y, x) AS theta, least(1.0, greatest(0.0, (sqrt(x * x + y * y) - 1.5) / 10.5)) AS s FROM placed),
along AS (SELECT id, imgVec, s * s * (3 - 2 * s) * 0.35 AS alpha, [cos(theta) * u1[i] + sin(theta) * u2[i] for i in range(1, len(u1) + 1)] AS d FROM warm, basis)
SELECT id, round(alpha, 6) AS step, round(alpha * list_inner_product(imgVec, d) / sqrt(list_inner_product(d, d)), 6) + 0.0 AS along FROM along""")
def pca_bias(spark, artworks, read):
    u1, u2 = map(scalars.literal_vector, stored_basis(artworks))
    x, y = (F.col("id") % 25 - 12).cast("double"), (F.col("objectId") % 23 - 11).cast("double")
    bias = scalars.directional_bias(F.atan2(y, x), scalars.temperature(scalars.radius(x, y)), u1, u2)
    rows = artworks.where(catalogue.eligible()).select("id", "imgVec", bias.alias("bias"))
    return rows.select("id", F.round(scalars.norm(F.col("bias")), 6).alias("step"), (F.round(scalars.dot(F.col("imgVec"), F.col("bias")), 6) + 0.0).alias("along"))


CHUNK_COLUMNS = ("pos", "id", "title", "imageUrl", "source", "similarity")


@query(f""", near AS (SELECT *, {sim_sql(TARGET)} AS sim FROM artworks WHERE {ELIGIBLE} AND id <> {TARGET}), ranked AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS rk FROM near)
SELECT CAST(rk - 48 AS INTEGER) AS pos, CAST(id AS BIGINT) AS id, title, {URL} AS "imageUrl", 'sim' AS source, round(sim, 6) AS similarity FROM ranked WHERE rk BETWEEN 48 AND 67""")
def field_chunk_center(spark, artworks, read):
    return rounded(field.one_chunk(artworks, TARGET, 0, 0, stored_basis(artworks)).data.select(*CHUNK_COLUMNS))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY md5(concat(id, ':', {noise.hash32(TARGET, 12, 5, 0)})), id) - 1 AS INTEGER) AS pos, CAST(id AS BIGINT) AS id, title, {URL} AS "imageUrl", 'rand' AS source, CAST(NULL AS DOUBLE) AS similarity
FROM artworks WHERE {ELIGIBLE} AND id <> {TARGET} ORDER BY pos LIMIT 20""")
def field_chunk_far(spark, artworks, read):
    return field.one_chunk(artworks, TARGET, 12, 5, stored_basis(artworks)).data.select(*CHUNK_COLUMNS)


def _floats(values: str) -> str:
    return f"list_transform({values}, lambda x: CAST(x AS FLOAT))"


def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / CAST(sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT))"


def picked_sql(targets: str, plan: str, basis: tuple[int, int] = (TARGET, SECOND)) -> str:
    """DuckDB steps to "picked" (request, place, pos, id, source, similarity) for a relation "asked" (request, target, count, excluded
    before the pools, excluded after) and a relation "plan" (request, place, x, y, seed, offset, n_sim, n_drift, n_rand).

    Noise and draws come from the stream of a chunk's seed, vectors in single precision; the pick walks over each chunk
    in turn and takes the first unused item of the pools in the order of the drawn pool's stand-ins.
    """
    along = _unit_sql("d")
    return f"""asked AS ({targets}), plan AS ({plan}),
warm AS (SELECT *, atan2(y, x) AS theta, least(1.0, greatest(0.0, (sqrt(x * x + y * y) - 1.5) / 10.5)) AS s FROM plan),
hot AS (SELECT *, s * s * (3 - 2 * s) AS t FROM warm),
wanted AS (SELECT request, place, seed, i FROM hot JOIN asked USING (request), unnest(range(1, 129 + "count")) AS r(i)), {STREAM},
noisy AS (SELECT request, place, list(sqrt(-2 * ln(u)) * cos(2 * pi() * v) ORDER BY i) AS eps
  FROM (SELECT request, place, i, u, lead(u) OVER (PARTITION BY request, place ORDER BY i) AS v FROM draws WHERE i <= 128) WHERE i % 2 = 1 GROUP BY ALL),
units AS (SELECT id, {_unit_sql(_floats("imgVec"))} AS v FROM artworks WHERE {ELIGIBLE}),
bases AS (SELECT {_floats("a.imgVec")} AS u1, {_floats("b.imgVec")} AS u2 FROM artworks a, artworks b WHERE a.id = {basis[0]} AND b.id = {basis[1]}),
ways AS (SELECT h.*, [u1[i] * CAST(cos(theta) AS FLOAT) + u2[i] * CAST(sin(theta) AS FLOAT) for i in range(1, len(u1) + 1)] AS d FROM hot h, bases),
pulled AS (SELECT *, list_transform({along}, lambda x: x * CAST(0.35 * t AS FLOAT)) AS bias FROM ways),
moved AS (SELECT request, place, [units.v[i] + bias[i] + CAST(eps[i] AS FLOAT) * CAST(0.05 + (0.35 - 0.05) * t AS FLOAT) for i in range(1, len(eps) + 1)] AS q
  FROM pulled JOIN noisy USING (request, place) JOIN asked USING (request) JOIN units ON units.id = asked.target),
vectors AS (SELECT request, place, list_transform({_unit_sql("q")}, lambda x: CAST(x AS DOUBLE)) AS q FROM moved
  UNION ALL SELECT request, -1, imgVec FROM asked JOIN artworks ON artworks.id = asked.target),
candidates AS (SELECT request, id, imgVec FROM asked, artworks WHERE {ELIGIBLE} AND id <> target AND NOT list_contains(before, id)),
near AS (SELECT request, place, id, list_cosine_similarity(imgVec, q) AS similarity, row_number() OVER (PARTITION BY request, place ORDER BY list_cosine_similarity(imgVec, q) DESC, id) AS rk
  FROM vectors JOIN candidates USING (request)),
dealt AS (SELECT request, place, id, row_number() OVER (PARTITION BY request, place ORDER BY md5(concat(id, ':', seed)), id) AS rk FROM plan JOIN candidates USING (request)),
sizes AS (SELECT request, place, n_sim, n_drift, n_rand, "offset", least(n_sim, (SELECT count(*) FROM near n WHERE n.request = p.request AND n.place = -1)) AS s_all, least(n_drift, (SELECT count(*) FROM near n WHERE n.request = p.request AND n.place = p.place)) AS d_all FROM plan p),
pools AS (
  SELECT z.request, z.place, 'sim' AS source, id, similarity, CASE WHEN "offset" < s_all AND rk <= "offset" THEN rk + s_all ELSE rk END AS turn FROM sizes z JOIN near n ON n.request = z.request AND n.place = -1 WHERE rk <= n_sim
  UNION ALL SELECT z.request, z.place, 'drift', id, similarity, CASE WHEN "offset" < d_all AND rk <= "offset" THEN rk + d_all ELSE rk END FROM sizes z JOIN near n ON n.request = z.request AND n.place = z.place WHERE rk <= n_drift
  UNION ALL SELECT z.request, z.place, 'rand', id, NULL, rk FROM sizes z JOIN dealt n ON n.request = z.request AND n.place = z.place WHERE rk <= n_rand),
lists AS (SELECT request, place, coalesce(list({{'id': id, 'source': source, 'similarity': similarity}} ORDER BY turn) FILTER (source = 'sim'), []) AS s,
  coalesce(list({{'id': id, 'source': source, 'similarity': similarity}} ORDER BY turn) FILTER (source = 'drift'), []) AS d, coalesce(list({{'id': id, 'source': source, 'similarity': similarity}} ORDER BY turn) FILTER (source = 'rand'), []) AS r
  FROM pools GROUP BY ALL),
steps AS (SELECT d.request, d.place, CAST(d.i - 129 AS INTEGER) AS pos, row_number() OVER (PARTITION BY d.request ORDER BY d.place, d.i) AS step,
  CASE WHEN u < (1 - t) ** 2 THEN 'sim' WHEN u < (1 - t) ** 2 + 2 * t * (1 - t) THEN 'drift' ELSE 'rand' END AS drawn FROM draws d JOIN hot USING (request, place) WHERE d.i > 128),
walk AS (
  SELECT request, CAST(0 AS BIGINT) AS step, -1 AS place, -1 AS pos, list_concat([target], "after") AS used, CAST(NULL AS STRUCT(id INTEGER, source VARCHAR, similarity DOUBLE)) AS got FROM asked
  UNION ALL
  SELECT request, step, place, pos, list_append(used, got.id), got FROM (
    SELECT w.request, p.step, p.place, p.pos, w.used,
      list_filter(CASE p.drawn WHEN 'sim' THEN list_concat(s, d, r) WHEN 'drift' THEN list_concat(d, s, r) ELSE list_concat(r, d, s) END, lambda c: NOT list_contains(w.used, c.id))[1] AS got
    FROM walk w JOIN steps p ON p.request = w.request AND p.step = w.step + 1 JOIN lists l ON l.request = p.request AND l.place = p.place)),
picked AS (SELECT request, place, pos, CAST(got.id AS BIGINT) AS id, got.source AS source, round(got.similarity, 6) AS similarity FROM walk WHERE got.id IS NOT NULL)"""


def _plan_sql(requests: list[tuple[int, int, list, list, field.Limits]]) -> str:
    """Rows (request, place, x, y, seed, offset, n_sim, n_drift, n_rand) of requests with their chunks in order, seeds and offsets."""
    rows = [f"({r}, {p}, {x}::DOUBLE, {y}::DOUBLE, {seed}, {offset}, {m.sim}, {m.drift}, {m.rand})" for r, _, chunks, more, m in requests for p, ((x, y), (seed, offset)) in enumerate(zip(chunks, more, strict=True))]
    return f"""SELECT * FROM (VALUES {', '.join(rows)}) AS v(request, place, x, y, seed, "offset", n_sim, n_drift, n_rand)"""


def _in_order(target: int, chunks: list, seed: int) -> tuple[list, list]:
    """A request's chunks nearest to the centre first, and of each the seed and the offset."""
    order = sorted(chunks, key=lambda c: (c[0] ** 2 + c[1] ** 2) ** 0.5)
    return order, [(noise.hash32(target, x, y, seed), noise.hash32(x + 100, y + 100, seed, i) % 100 if (x * x + y * y) ** 0.5 < 3 else 25 * i) for i, (x, y) in enumerate(order)]


MID, WANTED = (-3, 8), [(0, 0), (1, 0), (2, -3), (5, 5), (-3, 8), (12, 0)]
SHOWN = f'title, artist, {URL} AS "imageUrl", primaryImage AS "originalImageUrl", {SOURCE} AS "imageSource", objectId AS "objectId"'


def _steps(sql: str) -> str:
    """Steps of which one ("walk") is recursive, after the catalogue."""
    return f", {sql}"


@query(_steps(picked_sql(f"SELECT 0 AS request, {TARGET} AS target, 50 AS \"count\", CAST([] AS INTEGER[]) AS before, [5, 6] AS \"after\"", _plan_sql([(0, TARGET, [MID], [(noise.hash32(TARGET, *MID, 0), 0)], field.Limits.of_one())])) + f"""
SELECT pos, p.id, {SHOWN}, similarity, source FROM picked p JOIN artworks a ON a.id = p.id"""))
def field_chunk_mid(spark, artworks, read):
    return rounded(field.one_chunk(artworks, TARGET, *MID, stored_basis(artworks), count=50, exclude=[5, 6]).data)


@query(_steps(picked_sql(f"SELECT 0 AS request, {TARGET} AS target, 20 AS \"count\", [5, 6] AS before, [5, 6] AS \"after\"", _plan_sql([(0, TARGET, *_in_order(TARGET, WANTED, 0), field.Limits.of_many(len(WANTED)))])) + f"""
SELECT CAST(p.place AS INTEGER) AS place, x, y, pos, p.id, {SHOWN}, similarity, source FROM picked p JOIN artworks a ON a.id = p.id JOIN plan USING (request, place)"""))
def field_chunks(spark, artworks, read):
    return rounded(field.many_chunks(artworks, TARGET, WANTED, stored_basis(artworks), count=20, exclude=[5, 6]).data)


ASKED = [(1, 3, [(0, 0), (1, 0), (5, 5)], 12, 0, [5, 6]), (2, 5, [(12, 0)], 20, 7, []), (3, 6, [(2, -3), (-3, 8)], 10, 1, [3])]


@query(_steps(picked_sql(
    " UNION ALL ".join(f"SELECT {r} AS request, {t} AS target, {n} AS \"count\", CAST({e} AS INTEGER[]) AS before, CAST({e} AS INTEGER[]) AS \"after\"" for r, t, _, n, _, e in ASKED),
    _plan_sql([(r, t, *_in_order(t, c, s), field.Limits.of_many(len(c))) for r, t, c, _, s, _ in ASKED])) + f"""
SELECT CAST(p.request AS BIGINT) AS request, CAST(p.place AS INTEGER) AS place, x, y, pos, p.id, title, {URL} AS "imageUrl", {SOURCE} AS "imageSource", source, similarity FROM picked p JOIN artworks a ON a.id = p.id JOIN plan USING (request, place)"""))
def field_requests(spark, artworks, read):
    rows = [(r, t, [(float(x), float(y)) for x, y in c], n, s, e) for r, t, c, n, s, e in ASKED]
    asked = spark.createDataFrame(rows, "request long, targetId int, chunks array<struct<x double, y double>>, count int, seed long, exclude array<int>")
    return rounded(requests.chunks_of_requests(artworks, asked, stored_basis(artworks))[0])


@query()
def field_requests_table(spark, artworks, read):
    """A request for every hundredth item, placed by its id: what was found and picked for each."""
    asked = artworks.where(EVERY_HUNDREDTH).select(
        F.col("id").cast("long").alias("request"), F.col("id").alias("targetId"), F.array(*[F.struct((F.col("id") % a - b).cast("double").alias("x"), (F.col("id") % c - d).cast("double").alias("y")) for a, b, c, d in ((3, 1, 2, 0), (23, 11, 19, 9))]).alias("chunks"),
        F.lit(20).alias("count"), F.lit(0).cast("long").alias("seed"), F.array(F.lit(TARGET)).alias("exclude"),
    )
    return requests.chunks_of_requests(artworks, asked, stored_basis(artworks))[1]


UNITS = f"units AS (SELECT id, list_transform(imgVec, lambda x: x / (sqrt(list_sum(list_transform(imgVec, lambda y: y * y))) + 1e-12)) AS v FROM artworks WHERE {ELIGIBLE})"


def components_sql(k: int = 4, squarings: int = 18) -> str:
    """The first components by repeated squaring of the covariance, each taken out before the next."""
    sums = f"""{UNITS}, flat AS (SELECT id, i, v[i] AS x FROM units, unnest(range(1, {DIMENSION + 1})) AS r(i)), means AS (SELECT i, avg(x) AS m FROM flat GROUP BY i),
off AS (SELECT id, i, x - m AS x FROM flat JOIN means USING (i)), cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM units) - 1) AS c FROM off a JOIN off b USING (id) GROUP BY ALL),
c1 AS (SELECT list(row_ ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS row_ FROM cov GROUP BY i)), whole AS (SELECT sum(c) AS variance FROM cov WHERE i = j)"""
    for n in range(1, k + 1):
        sums += f""",
p{n} AS (SELECT 0 AS step, m FROM c{n} UNION ALL SELECT step + 1, [[x / tr for x in r] for r in q] FROM (SELECT step, [[list_inner_product(r, s) for s in m] for r in m] AS q, list_sum([list_inner_product(r, r) for r in m]) AS tr FROM p{n} WHERE step < {squarings})),
d{n} AS (SELECT m[list_position([m[i][i] for i in range(1, len(m) + 1)], list_max([m[i][i] for i in range(1, len(m) + 1)]))] AS r FROM p{n} WHERE step = {squarings}),
s{n} AS (SELECT list_transform(r, lambda x: x / sqrt(list_inner_product(r, r)) * sign(r[list_position(list_transform(r, lambda y: abs(y)), list_max(list_transform(r, lambda y: abs(y))))])) AS v FROM d{n}),
l{n} AS (SELECT v, list_inner_product(v, [list_inner_product(r, v) for r in m]) AS lambda_ FROM s{n}, c{n}),
c{n + 1} AS (SELECT [[m[i][j] - lambda_ * v[i] * v[j] for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)] AS m FROM c{n}, l{n})"""
    found = " UNION ALL ".join(f"SELECT {n} AS component, v, lambda_ FROM l{n}" for n in range(1, k + 1))
    return f", {sums}\nSELECT component, CAST(i - 1 AS INTEGER) AS i, round(v[i], 6) + 0.0 AS value, round(lambda_ / variance, 6) AS evr FROM ({found}), whole, unnest(range(1, {DIMENSION + 1})) AS r(i)"


def shown(basis: DataFrame) -> DataFrame:
    return basis.select("component", F.posexplode("vec").alias("i", "value"), F.round("evr", 6).alias("evr")).withColumn("value", F.round("value", 6) + 0.0)


@query(components_sql())
def pca_basis(spark, artworks, read):
    return shown(components.as_table(spark, components.fit(artworks)))


@query(f", {UNITS}, flat AS (SELECT i, v[i + 1] AS x, list_sum(v) AS all_of, v[(i + 1) % {DIMENSION} + 1] AS next FROM units, unnest(range(0, {DIMENSION})) AS r(i)) SELECT CAST(i AS INTEGER) AS i, count(*) AS n, round(sum(x), 6) + 0.0 AS total, round(sum(x * x), 6) + 0.0 AS squares, round(sum(x * next), 6) + 0.0 AS with_next, round(sum(x * all_of), 6) + 0.0 AS with_all FROM flat GROUP BY i")
def pca_moments(spark, artworks, read):
    p = F.col("products")
    of = {"total": F.col("total"), "squares": F.element_at(p, F.col("i") + 1), "with_next": F.element_at(p, (F.col("i") + 1) % DIMENSION + 1), "with_all": F.aggregate(p, F.lit(0.0), lambda a, x: a + x)}
    return components.moments(artworks, DIMENSION).select("i", "n", *[(F.round(c, 6) + 0.0).alias(name) for name, c in of.items()])


@query(components_sql())
def pca_incremental(spark, artworks, read):
    path = work.folder(spark)
    for batch in range(3):
        components.update(path, batch, artworks.where(F.col("id") % 3 == batch), DIMENSION)
    components.update(path, 2, artworks.where(F.col("id") % 3 == 2), DIMENSION)  # a repeated batch changes nothing
    return shown(components.as_table(spark, components.fit_state(components.state_at(spark, path))))


# Ingest


@query("SELECT id, primaryImage AS \"primaryImage\" FROM artworks WHERE primaryImage <> '' AND (localImageUrl IS NULL OR localImageUrl = '') ORDER BY id LIMIT 10000")
def download_queue(spark, artworks, read):
    return catalogue.download_queue(artworks)


@query("SELECT id, localImageUrl AS \"localImageUrl\" FROM artworks WHERE localImageUrl <> '' AND imgVec IS NULL ORDER BY id LIMIT 7500 OFFSET 5")
def embedding_queue(spark, artworks, read):
    return catalogue.embedding_queue(artworks, offset=5)


OUTCOMES = """queue AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM artworks WHERE primaryImage <> '' AND (localImageUrl IS NULL OR localImageUrl = '')),
outcomes AS (SELECT id, CAST((place - 1) // 25 + 1 AS INTEGER) AS batch, id % 4 <> 0 AS ok FROM queue)"""


def _refuse_every_fourth(url: str) -> bytes:
    if int(url.rsplit("/", 1)[1]) % 4 == 0:
        raise OSError("refused")
    return url.encode()


def _fetched(artworks):
    queue = catalogue.download_queue(artworks, count=None)
    return queue, ingest.fetch(queue, _refuse_every_fourth, lambda key, data: None)


@query(f""", {OUTCOMES} SELECT coalesce(batch, 0) AS batch, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, avg(CAST(ok AS DOUBLE)) AS success_rate FROM outcomes GROUP BY ROLLUP (batch)""")
def ingest_report(spark, artworks, read):
    queue, results = _fetched(artworks)
    return ingest.report(results.join(ingest.numbered(queue).select("id", "batch"), "id"))


@query(f""", {OUTCOMES} SELECT a.id, CASE WHEN o.ok THEN concat('https://img.example.org/artworks/', a.id, '.jpg') ELSE a.localImageUrl END AS "localImageUrl" FROM artworks a LEFT JOIN outcomes o ON a.id = o.id""")
def ingest_apply(spark, artworks, read):
    return ingest.with_urls(artworks, _fetched(artworks)[1]).select("id", "localImageUrl")


#: What the registry's encoder makes of an item's address, as SQL: whole numbers from its id, scaled to length one.
ENCODED = "[(id * (j + 3) % 17) - 8 for j in range(0, 64)]"
WEIGHED = "round(list_sum([{v}[j] * (j % 7 + 1) for j in range(1, len({v}) + 1)]) / {length}, 4) + 0.0"


def _encode_by_id(url: str) -> list[float]:
    number = int(url.rsplit("/", 1)[1].removesuffix(".jpg"))
    return [number * (j + 3) % 17 - 8 for j in range(DIMENSION)]


def _weighed(vector):
    """A number that depends on each entry of a vector and on its place."""
    terms = F.transform(vector, lambda x, j: x.cast("double") * ((j + 1) % 7 + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 4) + 0.0


EMBEDDED = f"""CASE WHEN imgVec IS NOT NULL THEN {WEIGHED.format(v="imgVec", length="1")} WHEN localImageUrl <> '' THEN {WEIGHED.format(v=ENCODED, length=f"sqrt(list_sum([x * x for x in {ENCODED}]))")} END"""


@query(f"SELECT id, {EMBEDDED} AS weighed FROM artworks")
def embedding_apply(spark, artworks, read):
    results = ingest.embed(catalogue.embedding_queue(artworks, count=None), _encode_by_id)
    return ingest.with_vectors(artworks, results).select("id", _weighed(F.col("imgVec")).alias("weighed"))


@query(f""", {OUTCOMES} SELECT a.id, CASE WHEN o.ok THEN concat('https://img.example.org/artworks/', a.id, '.jpg') ELSE a.localImageUrl END AS "localImageUrl", {EMBEDDED.replace("id *", "a.id *")} AS weighed
FROM artworks a LEFT JOIN outcomes o ON a.id = o.id""")
def parts_updated(spark, artworks, read):
    """The catalogue as a table in parts, after a batch of vectors, one of addresses, and both again."""
    path, width = work.folder(spark), 500
    parts.create(artworks, path, width=width)
    vectors = ingest.embed(catalogue.embedding_queue(artworks, count=None), _encode_by_id).where("ok")
    urls = _fetched(artworks)[1].where("ok")
    for batch, results, columns in ((1, vectors, {"imgVec": "vector"}), (2, urls, {"localImageUrl": "url"}), (1, vectors, {"imgVec": "vector"}), (2, urls, {"localImageUrl": "url"})):
        parts.apply(spark, path, results, batch, columns, width=width, schema=SCHEMA)
    return parts.read(spark, path, SCHEMA).select("id", "localImageUrl", _weighed(F.col("imgVec")).alias("weighed"))


#: Queue items with one of a few hosts each, a third of them on one host.
HOSTED = "concat('https://', CASE WHEN id % 3 = 0 THEN 'busy' ELSE concat('h', id % 11) END, '.example.org/', id)"


@query(f""", queue AS (SELECT id, {HOSTED} AS url, regexp_extract({HOSTED}, '//([^/]*)', 1) AS host FROM artworks),
turns AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS turn FROM queue)
SELECT id, url, host, turn, CAST((row_number() OVER (ORDER BY turn, host, id) - 1) // 25 + 1 AS INTEGER) AS batch FROM turns""")
def ingest_fair_batches(spark, artworks, read):
    queue = artworks.select("id", F.expr(HOSTED).alias("primaryImage"))
    return ingest.fair_batches(queue, 25, width=700)


@query(f""", {OUTCOMES} SELECT id, CASE WHEN ok THEN 'done' ELSE 'dead' END AS status, CASE WHEN ok THEN 1 ELSE 3 END AS attempts,
CASE WHEN ok THEN concat('https://img.example.org/artworks/', id, '.jpg') END AS url FROM outcomes""")
def downloads_settled(spark, artworks, read):
    """The whole download queue through the stream, which sees it twice: what became of each item, with three attempts for those that are refused."""
    folder = work.folder(spark)
    queue = catalogue.download_queue(artworks, count=None)
    for _ in range(2):
        queue.write.mode("append").parquet(f"{folder}/inbox")
    job = downloads.download_job(spark, f"{folder}/inbox", f"{folder}/events", f"{folder}/checkpoint", _refuse_every_fourth, lambda key, data: None, every="1 second", files_per_batch=1000, most=3, first=0.5)
    if not downloads.wait_until_settled(job, spark, f"{folder}/events"):
        raise RuntimeError("the stream did not settle")
    return downloads.outcomes(downloads.events_of(spark, f"{folder}/events")).select("id", "status", "attempts", "url")


# What users have seen

SEEN = "user_id, CAST(event_id * 7919 % 100003 + 1 AS BIGINT) AS id FROM events WHERE event_type = 'view'"
LISTED = "user_id, CAST(event_id % 1000 * 7919 % 100003 + 1 AS BIGINT) AS id, event_id FROM events WHERE event_type <> 'view'"


def _views(spark, read, sql: str) -> DataFrame:
    return spark.sql(f"SELECT {sql.replace('FROM events', 'FROM {events}')}", events=read("events"))


@query(f"SELECT l.* FROM (SELECT {LISTED}) l WHERE NOT EXISTS (SELECT 1 FROM (SELECT {SEEN}) s WHERE s.user_id = l.user_id AND s.id = l.id)".replace("SELECT l.*", "SELECT l.user_id, l.id, l.event_id"))
def unseen_items(spark, artworks, read):
    views = _views(spark, read, SEEN)
    halves = [seen.bitmaps(views.where(F.col("id") % 2 == k), "user_id") for k in (0, 1)]  # two days' views, say
    return seen.unseen(_views(spark, read, LISTED), seen.merged(*halves), "user_id")


@query(f"SELECT user_id AS user, count(DISTINCT id) AS n FROM (SELECT {SEEN}) GROUP BY user_id")
def seen_counts(spark, artworks, read):
    return seen.counts(seen.bitmaps(_views(spark, read, SEEN), "user_id"))


# Fusion, evaluation, telemetry


def _lists(artworks):
    rows = artworks.where(catalogue.eligible())
    return [fusion.ranked(knn.nearest(rows, vector, 100), "similarity") for vector in stored_vectors(artworks, (TARGET, SECOND))]


def _list_sql(item: int) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY {sim_sql(item)} DESC, id) AS rank FROM artworks WHERE {ELIGIBLE} QUALIFY rank <= 100"


def _fused_sql(w_text: float, w_image: float) -> str:
    return f""", t AS ({_list_sql(TARGET)}), i AS ({_list_sql(SECOND)}), f AS (SELECT coalesce(t.id, i.id) AS id, coalesce({w_text} / (60 + t.rank), 0) + coalesce({w_image} / (60 + i.rank), 0) AS score, t.rank AS text_rank, i.rank AS image_rank FROM t FULL JOIN i ON t.id = i.id)
SELECT id, round(score, 9) AS score, CAST(text_rank AS INTEGER) AS text_rank, CAST(image_rank AS INTEGER) AS image_rank FROM f ORDER BY round(score, 12) DESC, id LIMIT 50"""


@query(_fused_sql(1.0, 1.0))
def rrf_fuse(spark, artworks, read):
    return rounded(fusion.fuse(*_lists(artworks)), "score", digits=9)


@query(_fused_sql(2.0, 0.5))
def rrf_weighted(spark, artworks, read):
    return rounded(fusion.fuse(*_lists(artworks), w_text=2.0, w_image=0.5), "score", digits=9)


@query(_fused_sql(2.0, 1.5).replace(" QUALIFY rank <= 100", "").replace("CAST(text_rank AS INTEGER)", "text_rank").replace("CAST(image_rank AS INTEGER)", "image_rank"))
def rrf_whole(spark, artworks, read):
    rows = artworks.where(catalogue.eligible())
    for name, vector in zip(("text", "image"), stored_vectors(artworks, (TARGET, SECOND)), strict=True):
        rows = knn.with_similarity(rows, vector, name)
    best = fusion.fuse_whole(rows, w_text=2.0, w_image=1.5)[0]
    return rounded(best.withColumn("id", F.col("id").cast("int")), "score", digits=9)


def _judged(artworks, read):
    """Ranks for a few targets, and whether a result has the target's label."""
    vectors = stored_vectors(artworks, TARGETS)
    ranks = knn.nearest_of_many(artworks.where(catalogue.eligible()), vectors, [20] * len(vectors)).select("query", F.col("id").cast("int").alias("id"), "rank")
    label = read("embeddings").select((F.col("vec_id") + 1).cast("int").alias("id"), "label")
    asked = label.where(F.col("id").isin(list(TARGETS))).select((F.array_position(F.array(*map(F.lit, TARGETS)), F.col("id")) - 1).cast("int").alias("query"), F.col("label").alias("asked"))
    labels = ranks.select("query", "id").join(F.broadcast(asked), "query").join(label, "id").select("query", "id", (F.col("label") == F.col("asked")).alias("plausible"))
    return ranks, labels


JUDGED = f"""ranks AS (SELECT q.id AS query, a.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(a.imgVec, q.imgVec) DESC, a.id) AS rank, l.label = m.label AS plausible
  FROM (SELECT * FROM artworks WHERE {ELIGIBLE}) a, (SELECT * FROM artworks WHERE id IN {TARGETS}) q, embeddings l, embeddings m WHERE l.vec_id = a.id - 1 AND m.vec_id = q.id - 1 QUALIFY rank <= 20)"""


@query(f", {JUDGED} SELECT avg(CAST(plausible AS DOUBLE)) AS hit_rate, count(*) AS judged FROM ranks WHERE rank <= 5")
def relevance_top5(spark, artworks, read):
    return fusion.hit_rate(*_judged(artworks, read))


@query(f""", {JUDGED}, lists AS (SELECT query, id, rank, true AS of_text FROM ranks UNION ALL SELECT query, id, 21 - rank, false FROM ranks),
scored AS (SELECT w_text, w_image, query, id, sum(CASE WHEN of_text THEN w_text ELSE w_image END / (60 + rank)) AS score FROM lists, (VALUES (1.0, 0.0), (0.0, 1.0), (3.0, 1.0)) w(w_text, w_image) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY w_text, w_image, query ORDER BY round(score, 12) DESC, id) AS place FROM scored QUALIFY place <= 5)
SELECT CAST(w_text AS DOUBLE) AS w_text, CAST(w_image AS DOUBLE) AS w_image, avg(CAST(r.plausible AS DOUBLE)) AS hit_rate FROM best JOIN ranks r USING (query, id) GROUP BY w_text, w_image""")
def relevance_weight_grid(spark, artworks, read):
    ranks, labels = _judged(artworks, read)
    return fusion.weight_grid(ranks, ranks.withColumn("rank", 21 - F.col("rank")), labels, [(1.0, 0.0), (0.0, 1.0), (3.0, 1.0)])


OF_USER = {"text": ("view", "count(*)"), "image": ("purchase", "max(value)")}  # two rankings of items for each user


def _user_list(of: str) -> str:
    kind, score = OF_USER[of]
    rows = f"SELECT user_id AS query, event_id % 40 AS id, {score} AS score FROM events WHERE event_type = '{kind}' AND user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id, event_id % 40"
    return f"SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({rows}) a) b WHERE rank <= 20"


CLICKED = "SELECT DISTINCT user_id AS query, event_id % 40 AS id, true AS plausible FROM events WHERE event_type = 'click'"


@query(f""", lists AS (SELECT *, true AS of_text FROM ({_user_list("text")}) t UNION ALL SELECT *, false FROM ({_user_list("image")}) i), labels AS ({CLICKED}),
scored AS (SELECT w_text, w_image, query, id, sum(CASE WHEN of_text THEN w_text ELSE w_image END / (60 + rank)) AS score FROM lists, (VALUES (1.0, 0.0), (0.0, 1.0), (3.0, 1.0)) w(w_text, w_image) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY w_text, w_image, query ORDER BY round(score, 12) DESC, id) AS place FROM scored QUALIFY place <= 5),
judged AS (SELECT w_text, w_image, b.query, count(l.plausible) AS hits, count(*) AS judged FROM best b LEFT JOIN labels l ON l.query = b.query AND l.id = b.id GROUP BY ALL),
drawn AS (SELECT j.*, r, CAST('0x' || substr(md5('0:' || r || ':' || query), 1, 8) AS BIGINT) AS u FROM judged j, range(0, 101) t(r)),
counted AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE len(list_filter({fusion.poisson_bounds()}, lambda x: x <= u)) END AS times FROM drawn),
rates AS (SELECT w_text, w_image, r, CAST(sum(hits * times) AS DOUBLE) / sum(judged * times) AS rate FROM counted GROUP BY ALL)
SELECT CAST(w_text AS DOUBLE) AS w_text, CAST(w_image AS DOUBLE) AS w_image, round(max(rate) FILTER (r = 0), 9) AS hit_rate, round(quantile_cont(rate, 0.025) FILTER (r > 0), 9) AS low, round(quantile_cont(rate, 0.975) FILTER (r > 0), 9) AS high FROM rates GROUP BY ALL""")
def relevance_weight_intervals(spark, artworks, read):
    text, image, labels = [spark.sql(x.replace("FROM events", "FROM {events}"), events=read("events")) for x in (_user_list("text"), _user_list("image"), CLICKED)]
    return rounded(fusion.weight_intervals(text, image, labels, [(1.0, 0.0), (0.0, 1.0), (3.0, 1.0)], replicates=100), "hit_rate", "low", "high", digits=9)


@query("SELECT count(*) AS n, count(imgVec) AS covered, avg(CAST(imgVec IS NOT NULL AS DOUBLE)) AS coverage FROM artworks")
def vector_coverage(spark, artworks, read):
    return telemetry.vector_coverage(artworks)


@query("""SELECT count(*) AS n, count(*) FILTER (imgVec IS NULL) AS missing, count(*) FILTER (len(imgVec) <> 64) AS other_dimension, count(*) FILTER (len(list_filter(imgVec, lambda x: x IS NULL OR isnan(x))) > 0) AS not_numbers,
  count(*) FILTER (len(list_filter(imgVec, lambda x: x <> 0)) = 0) AS zero FROM artworks""")
def vector_integrity(spark, artworks, read):
    return telemetry.vector_integrity(artworks, 64)


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def telemetry_latency(spark, artworks, read):
    return rounded(telemetry.latency(read("events")), "p50", "p95", "p99")


@query("SELECT event_type AS kind, count(value) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY event_type")
def telemetry_latency_sketched(spark, artworks, read):
    """Quantiles from hourly sketches, and whether each one's rank among all values is within the stated error."""
    events = read("events")
    found = telemetry.latency_of_windows(work.written(telemetry.latency_sketches(events)))
    values = events.where("value is not null").select(F.col("event_type").alias("kind"), "value").join(F.broadcast(found), "kind")  # a row for each kind
    near = [((F.avg((F.col("value") < F.col(p)).cast("double")) - q <= telemetry.RANK_ERROR) & (F.avg((F.col("value") <= F.col(p)).cast("double")) - q >= -telemetry.RANK_ERROR)).alias(f"{p}_near") for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return values.groupBy("kind").agg(F.max("n").alias("n"), *near)


@query("""SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors,
  CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) / count(*) FILTER (event_type = 'view') AS click_through, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate FROM events""")
def telemetry_use(spark, artworks, read):
    return telemetry.use(read("events"))


@query("""SELECT count(*) AS n, count(*) FILTER (c.user_id IS NULL) AS no_result, avg(CAST(c.user_id IS NULL AS DOUBLE)) AS share
FROM (SELECT user_id FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id""")
def telemetry_no_results(spark, artworks, read):
    events = read("events")
    return telemetry.no_results(events.where("event_type = 'view'"), events.where("event_type = 'click'"), "user_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FOUND["similar_artworks"][0](spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
