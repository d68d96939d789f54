"""The thirteen operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .collocations import collocations
from .exact_dedup import exact_dedup
from .fingerprints import edited_likeness
from .jaccard_join import ngram_jaccard_join
from .line_dedup import line_dedup
from .packing import pack, token_count
from .pieces import encode_pieces
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .tables import table
from .toxicity import toxicity
from .vectors import nearest


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The content of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count().alias("n_tokens"))
    return pack(docs)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, piece_model()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "severity", "grade", "toxic")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard_join(docs).drop("row_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_graph_search, op2_packing, op3_quality_classifier, op4_sentencepiece, op5_toxicity,
        op6_chat_formatting, op7_ngram_jaccard_join, op8_line_dedup, op9_substring_dedup, op10_exact_dedup,
        op11_fingerprints, op12_prefix_trie, op13_collocations,
    )
}

#: The words of each text, one a row: r is the row, k the place, n the number of words.
_WORDS = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d), """

ORACLES = {
    "op7_ngram_jaccard_join": _WORDS
    + """runs AS (SELECT r, n, k, list(word) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM x),
        grams AS (SELECT DISTINCT r, array_to_string(g, ' ') AS g FROM runs WHERE k <= n - 4 OR (k = 1 AND n < 5)),
        named AS (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS s, count(*) AS size FROM grams GROUP BY r),
        sets AS (SELECT s, min(r) AS r, any_value(size) AS size, count(*) AS n_copies FROM named GROUP BY s),
        g AS (SELECT sets.s, size, g FROM sets JOIN grams USING (r)),
        near AS (SELECT a.s AS a, b.s AS b FROM g AS a JOIN g AS b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2 HAVING count(*) / (any_value(a.size) + any_value(b.size) - count(*)) >= 0.8),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reach AS (SELECT s AS a, s AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        ids AS (SELECT s, min(doc_id) AS least FROM named JOIN d USING (r) GROUP BY s),
        class AS (SELECT a AS s, min(least) AS class_id FROM reach JOIN ids ON reach.b = ids.s GROUP BY 1),
        counted AS (SELECT a AS s, count(*) AS n_links FROM links GROUP BY 1)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
        FROM d LEFT JOIN named USING (r) LEFT JOIN sets USING (s) LEFT JOIN class USING (s) LEFT JOIN counted USING (s)""",
    "op8_line_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
        t AS (SELECT r, k, doc_id, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
        sets AS (SELECT w, row_number() OVER () AS s, len(w) AS n, min(struct_pack(a := doc_id, b := k)) AS first FROM t WHERE len(w) > 0 GROUP BY w),
        x AS (SELECT s, n, first, unnest(w) AS word FROM sets),
        near AS (SELECT b.s, min(a.first) AS first FROM (SELECT a.s AS a, b.s AS b, count(*) AS c FROM x AS a JOIN x AS b ON a.word = b.word AND a.first < b.first AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2) AS p
            JOIN sets AS a ON a.s = p.a JOIN sets AS b ON b.s = p.b WHERE c / (a.n + b.n - c) >= 0.8 GROUP BY 1),
        gone AS (SELECT r, k FROM t JOIN sets USING (w) LEFT JOIN near USING (s) WHERE least(sets.first, coalesce(near.first, sets.first)) < struct_pack(a := doc_id, b := k)),
        kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM l ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, len(lines) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op9_substring_dedup": _WORDS
    + """runs AS (SELECT r, n, k, list(word) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g FROM x),
        starts AS (SELECT r, k, md5(array_to_string(g, ' ')) AS g FROM runs WHERE k <= n - 34),
        again AS (SELECT r, k FROM starts WHERE g IN (SELECT g FROM starts GROUP BY g HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM again),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM x ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # crc32 of the decimal id, a bit at a time; a node is a list of turns, of which unnest gives each prefix
    "op12_prefix_trie": r"""WITH t AS (SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list(turn ORDER BY pos) AS own FROM t GROUP BY conv_id),
        h AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::BIGINT)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM c),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c AS b ON b.conv_id = h.base),
        m AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
        p AS (SELECT conv_id, n, depth, turns[1:depth] AS path FROM m),
        nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM p GROUP BY path, depth),
        k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        x AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].text) ELSE 0 END AS saved FROM nodes LEFT JOIN k USING (path)),
        up AS (SELECT path[1:d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM x) GROUP BY 1)
        SELECT x.conv_id, x.depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
        FROM x JOIN up USING (path) LEFT JOIN x AS parent ON x.depth > 0 AND parent.path = x.path[1:x.depth - 1]""",
    "op13_collocations": r"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        s AS (SELECT row_number() OVER () AS s, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        x AS (SELECT s, lang, len(w) AS m, w, unnest(range(1, len(w) + 1)) AS i FROM s),
        g AS (SELECT lang, w[i:i + j - 1] AS p, j FROM x, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE i + j - 1 <= m),
        f AS (SELECT lang, p, j, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
        sub AS (SELECT lang, p[i:i + z - 1] AS p, max(f) AS longer FROM (SELECT *, unnest(range(1, j)) AS i FROM f WHERE j > 2), (SELECT unnest([2, 3]) AS z) WHERE z < j AND i + z - 1 <= j GROUP BY 1, 2),
        kept AS (SELECT f.* FROM f LEFT JOIN sub USING (lang, p) WHERE j > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * f::HUGEINT)),
        cuts AS (SELECT kept.lang, kept.p, kept.f AS a, k, l.f AS l, r.f AS r, (2000000 * kept.f::HUGEINT) // (l.f::HUGEINT + r.f) AS score FROM (SELECT *, unnest(range(1, j)) AS k FROM kept) AS kept
            JOIN f AS l ON l.lang = kept.lang AND l.p = kept.p[1:k] JOIN f AS r ON r.lang = kept.lang AND r.p = kept.p[k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
        FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
}
