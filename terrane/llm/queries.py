"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Stash, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The rules of the query.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_url_filter(spark, sf_dir):
    from .op1_urlfilter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def _url_sql() -> str:
    longest = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict
        FROM parts"""


def op2_mixing(spark, sf_dir):
    from .op2_mixing import mix

    return mix(table(spark, sf_dir, "documents"), Stash(spark))


def op3_html(spark, sf_dir):
    from .op3_html import extract

    return extract(table(spark, sf_dir, "pages"), Stash(spark))


def op4_toxicity(spark, sf_dir):
    from .op4_toxicity import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Stash(spark)).drop("evidence")


def op5_exact_dedup(spark, sf_dir):
    from .op5_exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), Stash(spark), keep="max")


def op6_minhash(spark, sf_dir):
    from .op6_minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), Stash(spark), words=3, percent=85)


def op7_language_id(spark, sf_dir):
    from .op7_langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark, sf_dir):
    from .op8_suffix_tree import judge

    return judge(table(spark, sf_dir, "documents"), Stash(spark))


def op9_embeddings(spark, sf_dir):
    from .op9_vamana import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), Stash(spark))


def op10_packing(spark, sf_dir):
    from .op10_packing import pack

    return pack(table(spark, sf_dir, "documents"), Stash(spark), _tokenizer())


def queries():
    return {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_html, op4_toxicity, op5_exact_dedup, op6_minhash, op7_language_id, op8_suffix_tree, op9_embeddings, op10_packing)}


def oracle_sql():
    return {
        "op1_url_filter": _url_sql(),
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
    }
