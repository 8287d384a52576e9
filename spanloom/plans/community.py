"""Registered queries on vectors, feedback, trust and proposals, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trust as T
from ..operators import vectors as V
from ..session import table, written
from ..sources import adapters as A
from ..sources.adapters import with_

TRIGGER = 0.35
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_SIMS = f", sims AS (SELECT f.t, b.accepted, b.row_id, b.author, round({_DOT.format(a='f.vec', b='b.vec')}, 6) AS sim FROM frames f CROSS JOIN feedback b)"
_BEST = _SIMS + ", best AS (SELECT t, accepted, arg_max(row_id, (sim, -row_id)) AS row_id, max(sim) AS sim FROM sims GROUP BY t, accepted)"
_FEED = with_("frames", "feedback")


def _prompts(s, d):
    """The first row of each author as a prompt."""
    return A.feedback(s, d).groupBy("author").agg(F.min_by("vec", "row_id").alias("vec")).select(F.concat(F.lit("prompt "), "author").alias("prompt"), "vec")


def _best(s, d):
    return V.nearest(A.frames(s, d), A.feedback(s, d))


def _ranges(s, d):
    """Ten suggestions of 60 ticks, every 45: they overlap."""
    return s.range(0, 10).select(F.col("id").alias("sugg"), (F.col("id") * 45).alias("start_ms"), (F.col("id") * 45 + 60).alias("end_ms"))


_RANGES = "ranges AS (SELECT id AS sugg, id * 45 AS start_ms, id * 45 + 60 AS end_ms FROM range(10) r(id))"


def first_range(s, d):
    """Frames in some suggestion, once, with the first that holds them."""
    r = F.broadcast(_ranges(s, d))
    f = A.frames(s, d).select("t", "author")
    return f.join(r, (F.col("t") >= F.col("start_ms")) & (F.col("t") < F.col("end_ms"))).groupBy("t", "author").agg(F.min("sugg").alias("sugg"))


def contributors(s, d):
    """Of each suggestion its authors by number of frames, the ten best, ties by first frame."""
    from pyspark.sql import Window as W

    r = F.broadcast(_ranges(s, d))
    n = A.frames(s, d).join(r, (F.col("t") >= F.col("start_ms")) & (F.col("t") < F.col("end_ms"))).groupBy("sugg", "author").agg(F.count(F.lit(1)).alias("frames"), F.min("t").alias("first"))
    w = W.partitionBy("sugg").orderBy(F.desc("frames"), "first")
    return n.withColumn("nth", F.row_number().over(w).cast("long")).where("nth <= 10").select("sugg", "author", "frames", "nth")


def weighted_feedback(s, d):
    """Local rows at weight 1 and peer rows at their author's trust, 0.1 where unknown; under 0.05 they are dropped."""
    trust = _direct(s, d).where("n > 0").select("author", "score")
    rows = A.feedback(s, d).select("row_id", "accepted", (F.col("author") * 7 + F.col("row_id") % 5).cast("long").alias("author"))
    local = rows.where("row_id % 10 = 1").select("row_id", "accepted", F.lit(None).cast("long").alias("author"), F.lit(1.0).alias("weight"))
    peers = rows.where("row_id % 10 <> 1").join(trust, "author", "left").select("row_id", "accepted", "author", F.coalesce("score", F.lit(0.1)).alias("weight"))
    return local.unionByName(peers.where("weight >= 0.05"))


def digest_dedup(s, d):
    """Rows of vectors, each sent twice with a little noise: the first of each digest stays, whatever its decision."""
    v = table(s, d, "embeddings").select("vec_id", V.quantised_digest(F.col("embedding")).alias("digest"))
    twice = v.withColumn("arrival", F.explode(F.array(F.col("vec_id") * 2, F.col("vec_id") * 2 + 7)))
    return twice.groupBy("digest").agg(F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("n_seen"))


def row_shapes(s, d):
    """Feedback rows, some broken on purpose, with the first rule each breaks."""
    category = F.expr("CASE WHEN vec_id % 11 = 0 THEN '<b>' WHEN vec_id % 13 = 0 THEN '' ELSE 'Cruelty' END")
    score = F.when(F.col("vec_id") % 7 == 0, 1.5).otherwise(0.85)
    vec = F.expr("CASE WHEN vec_id % 5 = 0 THEN slice(embedding, 1, 3) WHEN vec_id % 17 = 0 THEN transform(embedding, x -> x * 20) WHEN vec_id % 19 = 0 THEN transform(embedding, x -> cast(x * 0.5 as float)) ELSE embedding END")
    rows = table(s, d, "embeddings").select("vec_id", category.alias("category"), score.alias("score"), vec.alias("vec"))
    return rows.select("vec_id", V.shape_error(F.col("score"), F.col("vec"), F.col("category")).alias("verdict"))


def _direct(s, d):
    return T.fold(A.decisions(s, d))


def _edges(s, d):
    """Endorsements, made once of all lines: each step of a walk reads them again."""
    return written(A.endorsements(s, d), "endorsements")


def _seeds(edges):
    """Direct trust of suppliers: every third is trusted."""
    return edges.select("author").distinct().where("author % 3 = 0").select("author", (F.lit(0.8) + (F.col("author") % 5) / 10).alias("score"), F.lit(3).cast("long").alias("n"))


_SEEDS = ", seeds AS (SELECT author, 0.8 + (author % 5) / 10 AS score FROM (SELECT DISTINCT author FROM endorsements) WHERE author % 3 = 0)"
_WALK = _SEEDS + """
, walk(at_, target, value, depth, seen) AS (
  SELECT s.author, e.target, s.score * e.score, 1, [s.author] FROM seeds s JOIN endorsements e ON e.author = s.author
  UNION ALL SELECT w.target, e.target, w.value * e.score, w.depth + 1, list_append(w.seen, w.target) FROM walk w JOIN endorsements e ON e.author = w.target WHERE w.depth < 4 AND NOT list_contains(w.seen, w.target)),
boot AS (SELECT target AS author, CAST(sum(CAST(value * power(0.5, depth) AS DECIMAL(28,15))) AS DOUBLE) AS bootstrap FROM walk GROUP BY target)"""
#: One author after the other; an author's weight is that of the paths that no author who is gone leads.
_EVICTION = """
, parts AS MATERIALIZED (SELECT target AS author, seen AS via, CAST(value * power(0.5, depth) AS DECIMAL(28,15)) AS part FROM walk),
sizes AS MATERIALIZED (SELECT e.author, count(*) AS n, any_value(s.score) AS fixed FROM endorsements e LEFT JOIN seeds s USING (author) GROUP BY e.author),
gone AS (
  SELECT CAST([] AS BIGINT[]) AS out_, (SELECT CAST(sum(n) AS BIGINT) FROM sizes) AS total
  UNION ALL
  SELECT list_append(out_, author), total - n FROM (
    SELECT g.out_, g.total, s.author, s.n, round(coalesce(s.fixed, least(greatest(0.1 + coalesce(CAST(sum(p.part) FILTER (NOT list_has_any(p.via, g.out_)) AS DOUBLE), 0), 0.1), 0.4)), 9) AS weight
    FROM gone g JOIN sizes s ON NOT list_contains(g.out_, s.author) LEFT JOIN parts p ON p.author = s.author
    WHERE g.total > (SELECT sum(n) FROM sizes) * 2 // 3 GROUP BY g.out_, g.total, s.author, s.n, s.fixed)
  QUALIFY row_number() OVER (ORDER BY weight, author) = 1)"""
_FOLD = """, fold AS (SELECT author, seq, least(greatest(0.1 + CASE WHEN accepted THEN 0.05 ELSE -0.08 END, 0.0), 2.0) AS score FROM dec WHERE seq = 1
  UNION ALL SELECT f.author, d.seq, least(greatest(f.score + CASE WHEN d.accepted THEN 0.05 ELSE -0.08 END, 0.0), 2.0) FROM fold f JOIN dec d ON d.author = f.author AND d.seq = f.seq + 1),
direct AS (SELECT author, round(arg_max(score, seq), 6) AS score, count(*) AS n FROM fold GROUP BY author)"""
_DIRECT = with_("decisions", "feedback", recursive=True) + ", dec AS (SELECT author, seq, accepted FROM decisions)" + _FOLD.replace("0.1 + CASE", "CAST(0.1 AS DOUBLE) + CASE")


def effective_weights(s, d):
    edges = _edges(s, d)
    authors = edges.select(F.explode(F.array("author", "target")).alias("author")).distinct()
    return T.effective(authors, _seeds(edges), T.bootstrap(_seeds(edges), edges))


def bootstrapped(s, d):
    edges = _edges(s, d)
    return T.bootstrap(_seeds(edges), edges).withColumn("bootstrap", F.round("bootstrap", 6))


def evicted(s, d):
    """Endorsements that stay when two thirds of them may."""
    edges = _edges(s, d)
    return T.evict(edges, _seeds(edges), 2 * edges.count() // 3)


def _batches(s, d):
    """Endorsement batches that authors sent on some days, several times."""
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("peer"), (F.col("o_orderkey") % 6).alias("day"), F.col("o_orderkey").alias("arrival"), F.round(F.col("o_totalprice") / 250000, 4).alias("score"))


def flattened(s, d):
    """Endorsement entries of the latest batch of each peer and day, as edges; the last day wins."""
    last = T.latest(T.latest(_batches(s, d), ["peer", "day"], ["arrival"]), ["peer"], ["day"])
    return last.select("peer", F.explode(F.sequence(F.lit(1), (F.col("arrival") % 3 + 1).cast("int"))).alias("k"), "arrival", "score").select(F.col("peer").alias("author"), (F.col("arrival") + F.col("k")).alias("target"), "score")


def proposals(s, d):
    """Proposed categories by name without case: rows and peers, letters and digits only, most wanted first."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("peer"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN upper(substr(o_orderpriority, 3)) WHEN 1 THEN substr(o_orderpriority, 3) ELSE concat('Cat', o_orderkey % 9) END").alias("name"))
    named = o.select("peer", F.lower("name").alias("name")).where(F.col("name").rlike("^[a-z0-9]+$"))
    accepted = s.createDataFrame([("urgent",), ("cat3",)], "name string")
    dismissed = s.createDataFrame([("cat5",)], "name string")
    left = named.join(F.broadcast(accepted), "name", "left_anti").join(F.broadcast(dismissed), "name", "left_anti")
    return left.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("peer").alias("n_peers"))


def queries():
    return {
        "j7_nearest_feedback": _best,
        "g4_score_factors": lambda s, d: V.factors(_best(s, d), TRIGGER, 0.8),
        "j8_prompt_scores": lambda s, d: V.prompt_scores(A.frames(s, d), _prompts(s, d)),
        "j2_frames_in_suggestions": first_range,
        "j3_contributing_authors": contributors,
        "j5_weighted_feedback": weighted_feedback,
        "u3_digest_dedup": digest_dedup,
        "p9_row_shapes": row_shapes,
        "a20_trust_fold": _direct,
        "g1_bootstrap": bootstrapped,
        "g2_effective_weight": effective_weights,
        "o5_outbound_endorsements": lambda s, d: T.outbound(_direct(s, d).withColumn("score", F.round(F.col("score") * 4, 6))),
        "o6_evicted_endorsements": evicted,
        "s12_latest_batches": lambda s, d: T.latest(_batches(s, d), ["peer", "day"], ["arrival"]),
        "j21_endorsement_edges": flattened,
        "a7_proposals": proposals,
    }


_BATCHES = "batches AS (SELECT o_custkey AS peer, o_orderkey % 6 AS day, o_orderkey AS arrival, round(o_totalprice / 250000, 4) AS score FROM orders)"


def oracle_sql():
    return {
        "j7_nearest_feedback": _FEED + _BEST + " SELECT * FROM best",
        "g4_score_factors": _FEED + _BEST + f" SELECT t, round(coalesce(max(CASE WHEN sim >= {TRIGGER} THEN 1 + 0.8 * (1.15 - 1) ELSE 1.0 END) FILTER (accepted), 1.0) * coalesce(max(CASE WHEN sim >= {TRIGGER} THEN 1 + 0.8 * (0.5 - 1) ELSE 1.0 END) FILTER (NOT accepted), 1.0), 6) AS factor FROM best GROUP BY t".replace("1 + 0.8", "CAST(1 AS DOUBLE) + 0.8"),
        "j8_prompt_scores": _FEED + f" SELECT f.t, 'prompt ' || b.author AS prompt, round(least(greatest(({_DOT.format(a='f.vec', b='b.vec')} - 0.15) / 0.2, 0.0), 1.0), 6) AS score FROM frames f CROSS JOIN (SELECT author, arg_min(vec, row_id) AS vec FROM feedback GROUP BY author) b",
        "j2_frames_in_suggestions": _FEED + ", " + _RANGES + " SELECT t, author, min(sugg) AS sugg FROM frames JOIN ranges ON t >= start_ms AND t < end_ms GROUP BY t, author",
        "j3_contributing_authors": _FEED + ", " + _RANGES + ", n AS (SELECT sugg, author, count(*) AS frames, min(t) AS first FROM frames JOIN ranges ON t >= start_ms AND t < end_ms GROUP BY ALL) SELECT sugg, author, frames, row_number() OVER (PARTITION BY sugg ORDER BY frames DESC, first) AS nth FROM n QUALIFY nth <= 10",
        "j5_weighted_feedback": _DIRECT + ", rows_ AS (SELECT row_id, accepted, CAST(author * 7 + row_id % 5 AS BIGINT) AS author FROM feedback) SELECT row_id, accepted, CAST(NULL AS BIGINT) AS author, CAST(1.0 AS DOUBLE) AS weight FROM rows_ WHERE row_id % 10 = 1 UNION ALL SELECT row_id, accepted, r.author, coalesce(score, 0.1) FROM rows_ r LEFT JOIN direct d ON d.author = r.author WHERE row_id % 10 <> 1 AND coalesce(score, 0.1) >= 0.05",
        "u3_digest_dedup": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (CAST(round(CAST(x AS FLOAT) * CAST(10000 AS FLOAT)) AS BIGINT) + 4294967296) % 4294967296) AS u FROM embeddings), h AS (SELECT vec_id, sha256(unhex(array_to_string(list_transform(u, lambda x: printf('%02x%02x%02x%02x', x % 256, x // 256 % 256, x // 65536 % 256, x // 16777216)), ''))) AS digest FROM v), twice AS (SELECT digest, unnest([vec_id * 2, vec_id * 2 + 7]) AS arrival FROM h) SELECT digest, min(arrival) AS arrival, count(*) AS n_seen FROM twice GROUP BY digest",
        "p9_row_shapes": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '<b>' WHEN vec_id % 13 = 0 THEN '' ELSE 'Cruelty' END AS category, CASE WHEN vec_id % 7 = 0 THEN 1.5 ELSE 0.85 END AS score,
              CASE WHEN vec_id % 5 = 0 THEN embedding[1:3] WHEN vec_id % 17 = 0 THEN list_transform(embedding, lambda x: CAST(x * 20 AS FLOAT)) WHEN vec_id % 19 = 0 THEN list_transform(embedding, lambda x: CAST(x * 0.5 AS FLOAT)) ELSE embedding END AS vec FROM embeddings)
            SELECT vec_id, CASE WHEN NOT regexp_full_match(category, '[A-Za-z0-9 /.-]{1,64}') THEN 'category' WHEN NOT score BETWEEN 0 AND 1 THEN 'score' WHEN len(vec) NOT IN (64, 512, 768, 1024) THEN 'dimension'
              WHEN list_max(list_transform(vec, lambda x: abs(x))) > 1.5 THEN 'value' WHEN abs(sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 0.05 THEN 'norm' ELSE 'ok' END AS verdict FROM r""",
        "a20_trust_fold": _DIRECT + " SELECT * FROM direct",
        "g1_bootstrap": with_("endorsements", recursive=True) + _WALK + " SELECT author, round(bootstrap, 6) AS bootstrap FROM boot",
        "g2_effective_weight": with_("endorsements", recursive=True) + _WALK + ", authors AS (SELECT author FROM endorsements UNION SELECT target FROM endorsements) SELECT a.author, round(coalesce(s.score, least(greatest(0.1 + coalesce(b.bootstrap, 0), 0.1), 0.4)), 6) AS weight FROM authors a LEFT JOIN seeds s USING (author) LEFT JOIN boot b ON b.author = a.author",
        "o5_outbound_endorsements": _DIRECT + " SELECT author AS target, round(score * 4, 6) AS score FROM direct WHERE round(score * 4, 6) >= 0.8 ORDER BY 2 DESC, 1 LIMIT 50",
        "o6_evicted_endorsements": with_("endorsements", recursive=True) + _WALK + _EVICTION + " SELECT * FROM endorsements WHERE NOT list_contains((SELECT arg_max(out_, len(out_)) FROM gone), author)",
        "s12_latest_batches": f"WITH {_BATCHES} SELECT * FROM batches QUALIFY row_number() OVER (PARTITION BY peer, day ORDER BY arrival DESC) = 1",
        "j21_endorsement_edges": f"WITH {_BATCHES}, l AS (SELECT * FROM batches QUALIFY row_number() OVER (PARTITION BY peer, day ORDER BY arrival DESC) = 1), m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY peer ORDER BY day DESC) = 1), x AS (SELECT peer, arrival, score, unnest(range(1, arrival % 3 + 2)) AS k FROM m) SELECT peer AS author, arrival + k AS target, score FROM x",
        "a7_proposals": "WITH n AS (SELECT o_custkey AS peer, lower(CASE o_orderkey % 4 WHEN 0 THEN upper(substr(o_orderpriority, 3)) WHEN 1 THEN substr(o_orderpriority, 3) ELSE 'Cat' || (o_orderkey % 9) END) AS name FROM orders) SELECT name, count(*) AS n_rows, count(DISTINCT peer) AS n_peers FROM n WHERE regexp_full_match(name, '[a-z0-9]+') AND name NOT IN ('urgent', 'cat3', 'cat5') GROUP BY name",
    }
