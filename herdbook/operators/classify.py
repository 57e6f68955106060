"""Classifying practices by keywords, ranking their pages, counting people in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.functions.fuzzy import any_partial_ratio, may_reach, ratio, share_contained
from herdbook.functions.text import contains_any, keyword_score, null_if_blank
from herdbook.functions.url import joined

PEOPLE = "array<struct<Name:string,Gender:string,Role:string,Uncertain:boolean>>"
#: What a team page's words weigh unless the caller gives a table of weights.
TEAM_WEIGHTS = {"team": 20, "équipe": 20, "equipo": 20, "squadra": 20, "unser team": 25, "tierarzt": 5, "tierärztin": 5, "vétérinaire": 5, "veterinaria": 5, "veterinario": 5, "vet": 5, "praxis": 3, "doctor": 5, "dokter": 5}


#: Words on buttons that accept cookies, by language.
COOKIE_WORDS_BY_LANGUAGE = {
    "en": ("accept", "agree", "consent", "allow", "ok", "yes"),
    "de": ("akzeptieren", "zustimmen", "erlauben", "ok", "ja"),
    "fr": ("accepter", "consentir", "autoriser", "ok", "oui"),
    "it": ("accettare", "consentire", "autorizzare", "ok", "sì"),
    "es": ("aceptar", "consentir", "permitir", "ok", "sí"),
    "pt": ("aceitar", "consentir", "permitir", "ok", "sim"),
    "nl": ("accepteren", "toestaan", "instemmen", "ok", "ja"),
    "pl": ("zaakceptować", "zgodzić", "zezwolić", "ok", "tak"),
    "cs": ("přijmout", "souhlasit", "povolit", "ok", "ano"),
    "ro": ("accepta", "consimți", "permite", "ok", "da"),
}
COOKIE_WORDS = tuple(sorted({w for words in COOKIE_WORDS_BY_LANGUAGE.values() for w in words}))


def keyword_hits(docs: DataFrame, key: str, text: str, lang: str, keywords: DataFrame, kw_lang: str, kw_word: str, kw_kind: str, also: str | None = "en", fuzzy: int | None = None) -> DataFrame:
    """(key, kind): the kinds of which a keyword of the document's language, or of `also`, is in the text, in any case.

    Documents of unknown language count as `also`; without `also` they have no keywords. The keywords, a table of the
    caller's and not of the data's size, become one expression per kind, so that no text is shuffled. With `fuzzy`, a keyword
    also hits if its best window reaches that ratio; such windows are looked for only around an exact part of the keyword.
    """
    rows = keywords.select(F.lower(kw_lang), kw_word, kw_kind).where(F.trim(kw_word) != "").distinct().collect()
    known = sorted({r[0] for r in rows if r[0]})
    l = F.when(F.lower(F.col(lang)).isin(known), F.lower(F.col(lang))).otherwise(F.lit(also)) if known else F.lit(also)
    low = F.lower(F.col(text))
    kinds = []
    for kind in sorted({r[2] for r in rows}):
        hit = F.lit(False)
        for code in known:
            words = sorted({r[1].lower() for r in rows if r[2] == kind and r[0] == code})
            some = F.lit(False)
            for w in words:
                some = some | F.contains(low, F.lit(w))
            if fuzzy and words:
                some = some | any_partial_ratio(low, words, fuzzy)
            hit = hit | (some if code == also else (l == code) & some)
        kinds.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(kind)))
    return docs.select(key, F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kind"))


def clinic_status(is_clinic: Column, is_other: Column) -> Column:
    """yes if a clinic's keyword was found, else no if another's, else uncertain."""
    return F.when(is_clinic, "yes").when(is_other, "no").otherwise("uncertain")


def species(docs: DataFrame, hits: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """docs with `species`: the categories found, in their order, joined by ', '; null if there are none."""
    order = F.create_map(*(F.lit(x) for i, c in enumerate(categories) for x in (c, i)))
    found = hits.where(F.col("kind").isin(categories)).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.try_element_at(order, "kind").alias("o"), "kind"))).alias("k"))
    return docs.join(found.select(key, F.array_join(F.transform("k", lambda x: x.kind), ", ").alias("species")), key, "left")


def service_links(pages: DataFrame, key: str, base: str, links: str, keywords: list[str]) -> DataFrame:
    """(key, href): the distinct targets, seen from the page's URL, of links whose text holds one of the keywords in any case."""
    l = pages.select(key, base, F.explode(links).alias("l")).where(contains_any(F.lower("l.anchor"), [w.lower() for w in keywords]))
    return l.select(key, joined(F.col(base), F.col("l.href")).alias("href")).distinct()


def keep_or(old: Column, new: Column) -> Column:
    """The old value where there is one, else the new."""
    return F.coalesce(null_if_blank(old), new)


def reason(old: Column, found: Column) -> Column:
    """Why a field is as it is: skipped (it was there), match, no_species_match."""
    return F.when(null_if_blank(old).isNotNull(), "skipped").when(found.isNotNull(), "match").otherwise("no_species_match")


def people(reply: Column) -> Column:
    """The people in a model's reply: the JSON list from the first '[' to the last ']'; null if that isn't one."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), PEOPLE)


def team_counts(p: Column) -> dict[str, Column]:
    """FD, MD, FND, MND: women and men who are doctors, and who aren't; all null if all are 0 or the reply was bad."""
    norm = lambda x: F.lower(F.trim(x))
    n = lambda gender, doctor: F.size(F.filter(p, lambda q: F.coalesce((norm(q.Gender) == gender) & ((norm(q.Role) == "doctor") == F.lit(doctor)), F.lit(False))))
    raw = {"FD": n("female", True), "MD": n("male", True), "FND": n("female", False), "MND": n("male", False)}
    some = p.isNotNull() & (raw["FD"] + raw["MD"] + raw["FND"] + raw["MND"] > 0)
    return {k: F.when(some, v) for k, v in raw.items()}


def reprocess(df: DataFrame, replies: DataFrame, key: str, reply: str) -> tuple[DataFrame, DataFrame]:
    """(df with counts filled from replies where all four were null, keys that still have none)."""
    names = ["FD", "MD", "FND", "MND"]
    new = replies.groupBy(key).agg(F.max(reply).alias("_r")).select(key, *(c.alias(f"_n{n}") for n, c in team_counts(people(F.col("_r"))).items()))
    out = df.join(new, key, "left")
    open_ = F.coalesce(*names).isNull()
    out = out.select(*(F.when(open_, F.col(f"_n{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))
    return out, out.where(open_).select(key)


def page_score(text: Column, url_path: Column, weights: dict[str, int] = TEAM_WEIGHTS, in_path: tuple[str, ...] = ("team", "equipe", "equipo", "squadra", "about", "ueber-uns")) -> Column:
    """How much a page looks like a team page: weighted words, 25 for each team word in the path, -15 for the root without a
    strong word (20 or more); 0 for texts of 200 characters or fewer."""
    strong = keyword_score(text, {w: 1 for w, n in weights.items() if n >= 20}) > 0
    path_score = F.lit(0)
    for w in in_path:
        path_score = path_score + F.when(F.contains(F.lower(url_path), F.lit(w)), 25).otherwise(0)
    root = F.coalesce(url_path, F.lit("")).isin("", "/")
    total = keyword_score(text, weights) + F.coalesce(path_score, F.lit(0)) - F.when(root & ~strong, 15).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) <= 200, 0).otherwise(total)


def best_page(pages: DataFrame, site: str, url: str, score: str, preferred: str, home: Column) -> DataFrame:
    """(site, best): the only preferred page of a site, else its best-scored preferred, else its best other with a score above 0,
    else its home page. Ties go to the first URL. `preferred` is a boolean column."""
    top = lambda cond: F.max_by(F.col(url), F.when(cond & (F.col(score) > 0), F.struct(F.col(score), F.xxhash64(url))))
    g = pages.groupBy(site).agg(F.count_if(F.col(preferred)).alias("n"), F.min(F.when(F.col(preferred), F.col(url))).alias("one"), top(F.col(preferred)).alias("p"), top(~F.col(preferred)).alias("c"), F.min(home).alias("h"))
    return g.select(site, F.coalesce(F.when(F.col("n") == 1, F.col("one")), "p", "c", "h").alias("best"))


def cookie_label(label: Column, keywords: tuple[str, ...] = COOKIE_WORDS, percent: int = 85) -> Column:
    """True if a button's label holds a word of consent, or resembles one by at least `percent`."""
    low = F.lower(F.trim(label))
    near = F.lit(False)
    for w in keywords:
        near = near | (may_reach(low, F.lit(w), percent) & (ratio(low, F.lit(w)) >= percent))
    return F.coalesce(contains_any(low, list(keywords)) | near, F.lit(False))


def merged_profiles(profiles: DataFrame, site: str, url: str, text: str, main: str, most: float = 0.85) -> DataFrame:
    """(site, merged): a site's main text with those of its profiles by URL, each under its URL; blank ones and those of which
    a share of `most` or more is in the main text are left out. A site's profiles are few (team_profiles caps them)."""
    kept = profiles.where(F.trim(text) != "").withColumn("_s", share_contained(F.col(text), F.col(main))).where(F.col("_s") < most)
    parts = kept.groupBy(site).agg(F.array_sort(F.collect_list(F.struct(F.col(url).alias("u"), F.col(text).alias("t")))).alias("p"))
    out = profiles.groupBy(site).agg(F.min(main).alias("_m")).join(parts, site, "left")
    pages = F.transform(F.coalesce("p", F.array().cast("array<struct<u:string,t:string>>")), lambda x: F.concat(F.lit("[Page: "), x.u, F.lit("]\n"), x.t))
    return out.select(site, F.concat_ws("\n\n", F.concat(F.array("_m"), pages)).alias("merged"))


def site_links(pages: DataFrame, url: str, links: str) -> DataFrame:
    """(url, href, anchor): the distinct links of each page that stay on its host, without fragments, files and downloads.

    `links` is an array of (href, anchor). Of links to one path the first anchor by text is kept.
    """
    from herdbook.functions.url import host, is_binary, joined, path, without_fragment

    l = pages.select(url, F.explode(links).alias("l")).where(~F.col("l.href").startswith("#"))
    full = without_fragment(joined(F.col(url), F.col("l.href")))
    l = l.select(url, full.alias("href"), F.col("l.anchor").alias("anchor"))
    l = l.where((host(F.col("href")) == host(F.col(url))) & ~is_binary(F.col("href")) & ~F.lower("href").rlike("download|install|os="))
    return l.groupBy(url, path(F.col("href")).alias("_p")).agg(F.min("href").alias("href"), F.min("anchor").alias("anchor")).drop("_p")


def team_profiles(links: DataFrame, team_url: Column, most: int = 50) -> DataFrame:
    """The links below a team page's path, the first `most` of each page in order of the URL."""
    from pyspark.sql import Window as W

    below = links.where(F.col("href").startswith(team_url) & (F.length("href") > F.length(team_url)))
    return below.withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy("href"))).where(F.col("_n") <= most).drop("_n")
