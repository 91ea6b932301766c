"""The registered queries opN_<name>: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, cover_tree, decontaminate, kneser_ney, langid, main_text, mixing, ngram_join, repair, search, toxicity, vp_tree, warc
from .common import Stage, hash_sample, reachable, remainder

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(key: str, mod: int, rest: int):
    """Whether a row is held out; rows without the key are not."""
    return F.coalesce(remainder(key, mod) == rest, F.lit(False))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit_languages(docs.filter(~held("doc_id", 3, 1)), "text", "lang", "doc_id")


@register("op1_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify_language(language_model(docs), F.col("text"))
    return docs.select("doc_id", held("doc_id", 3, 1).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", F.col("f.lang").alias("lang_pred"), "f.score", "f.ambiguous")


@register("op2_main_text")
def _(spark, sf_dir):
    pages = main_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register("op3_kneser_ney")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.filter(~held("doc_id", 7, 2)))
    found = kneser_ney.score(model, docs)
    return found.select("doc_id", held("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Labels are sampled before their texts are fetched, so the join sends some 8,000 ids to the documents and moves
    no other text; repeated labels of a document agree on the larger."""
    labels = labels.filter(~held("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic in (0, 1)")
    chosen = hash_sample(labels, "toxic", "doc_id", toxicity.PER_LABEL).select("doc_id", "toxic")
    return toxicity.fit_toxicity(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", "toxic", "doc_id")


@register("op4_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.toxicity_score(toxicity_model(docs, table(spark, sf_dir, "labels")), F.col("text"))
    return docs.select("doc_id", held("doc_id", 4, 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@register(
    "op5_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
      q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
      m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS k FROM q)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> k THEN k END AS refers_to FROM m""",
)
def _(spark, sf_dir):
    folder = f"{Stage(spark, 'archives').folder}/warc"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, keep_payload=False).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


@register("op6_vp_tree")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vp_tree.nearest(vp_tree.build_index(vectors), vectors.filter("vec_id % 50 = 0"))


@register("op7_source_mixing")
def _(spark, sf_dir):
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


@register(
    "op8_chat",
    """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
      e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\\\#<\n]', '', 'g')) AS role_chars,
        length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) AS text_chars FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(13 + role_chars + text_chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
)
def _(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    records = rows.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat.format_and_read_back(records).withColumn("conv_id", F.col("conv_id").cast("long"))


@register(
    "op9_ngram_join",
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS shingle
        FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
      n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
      p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
      l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
      reach(x, y) AS (SELECT r, r FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
      low AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = y GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN low USING (r)""",
)
def _(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(
    "op10_decontamination",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS10} AS w FROM documents),
      b AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
      b2 AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
      bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS win
        FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM b2)),
      dw AS (SELECT r, i, l, array_to_string(w[i : i + l - 1], ' ') AS win
        FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
      h AS (SELECT DISTINCT r, i, dw.l AS l, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
      c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM h) GROUP BY r),
      t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
)
def _(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register(
    "op13_conversation_repair",
    r"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
      f AS (SELECT *, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(name)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(name[i // 8 + 1]) ELSE 0 END::BIGINT)),
          lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::BIGINT) ELSE xor(c, b) // 2 END)) % 20 AS fate FROM k),
      d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
          CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1:1] AS c FROM d),
      e AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS known,
          regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
      n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (known AND NOT blank) AS duplicate,
          count(*) FILTER (cut AND NOT known AND NOT blank) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM e GROUP BY conv_id),
      fits(q, t, said) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
      kept(q, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
      added(q, t, cost, audit, lines) AS (SELECT q, q, 0, '', []::VARCHAR[] FROM fits UNION ALL SELECT q, t, 3, 'I', [said || ':'] FROM fits
        UNION ALL SELECT a.q, b.t, 6, 'II', [a.said || ':', b.said || ':'] FROM fits a JOIN fits b ON b.q = a.t),
      edits AS (SELECT conv_id, i, q, t, audit, cost, line FROM e, LATERAL (
          SELECT q, q AS t, 'D' AS audit, 4 AS cost, []::VARCHAR[] AS line FROM fits
          UNION ALL SELECT q, t, 'K', CASE WHEN e.cut THEN 3 ELSE 0 END, [e.role || ':' || e.text] FROM kept WHERE kept.c = e.c AND NOT e.blank AND NOT e.known
          UNION ALL SELECT q, t, 'R', CASE WHEN e.cut THEN 6 ELSE 3 END, [said || ':' || e.text] FROM fits WHERE NOT e.blank AND NOT e.known)),
      p AS (SELECT conv_id, 0::BIGINT AS i, t AS q, cost, audit, lines FROM (SELECT DISTINCT conv_id FROM e) JOIN added ON added.q = 0
          QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1
        UNION ALL SELECT p.conv_id, edits.i, a.t, p.cost + edits.cost + a.cost, p.audit || edits.audit || a.audit, p.lines || edits.line || a.lines
          FROM p JOIN edits ON edits.conv_id IS NOT DISTINCT FROM p.conv_id AND edits.i = p.i + 1 AND edits.q = p.q JOIN added a ON a.q = edits.t
          QUALIFY row_number() OVER (PARTITION BY p.conv_id, a.t ORDER BY p.cost + edits.cost + a.cost, p.audit || edits.audit || a.audit) = 1),
      best AS (SELECT n.*, p.cost, p.audit, p.lines FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.rows = p.i WHERE p.q IN (0, 3)
          QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost, p.audit) = 1)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.summary(repair.repair(repair.damage(rows))).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register(
    "op11_cover_tree",
    """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
      u AS (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
        WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
      l AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9 * a.size * b.size),
      reach(x, y) AS (SELECT r, r FROM u UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
      low AS (SELECT x AS r, min(vec_id) AS least FROM reach JOIN v ON v.r = y GROUP BY x),
      n AS (SELECT x AS r, count(*) AS n FROM l GROUP BY x)
    SELECT vec_id, coalesce(n, 0) AS n_links, CASE WHEN low.r IS NULL THEN vec_id ELSE least END AS component_id,
      CASE WHEN low.r IS NULL THEN true ELSE vec_id IS NOT DISTINCT FROM least END AS kept FROM v LEFT JOIN low USING (r) LEFT JOIN n USING (r)""",
)
def _(spark, sf_dir):
    return cover_tree.linked_vectors(table(spark, sf_dir, "embeddings"))


_TERMS12 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register(
    "op12_ranked_search",
    f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS12} AS w FROM documents),
      z AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
      t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
      f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, z GROUP BY term, docs),
      m AS (SELECT r, doc_id, 50 + (50 * len(w) * docs) // total AS m FROM d, z WHERE len(w) > 0),
      b AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS12}) AS term FROM benchmark)),
      s AS (SELECT i, item_id, r, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM b JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 50""",
)
def _(spark, sf_dir):
    return search.ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
