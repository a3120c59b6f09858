"""Per-document text operators.

Two shapes only:

* row-local measures (normalise, statistics, readability, sentiment, domain
  and type scoring, lexical diversity, complexity) are array expressions on
  the document row: no shuffle, one map stage;
* ranked term lists (TF-IDF keywords, key phrases, n-gram keywords, headings)
  are counted inside the document row as well (``row_terms``).  Only where the
  pages of a document are rows of their own (``tfidf_keywords``, ``headings``)
  are they exploded, aggregated with map-side partial aggregation and cut to
  the top k per document (partial group limit before the shuffle).

Ties are broken by first position, as ``Counter.most_common`` and Python's
stable sort would: carry ``(page_no, pos)`` and order by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicons as L
from quarry.functions import wording as S
from quarry.functions.text import (WS, az_words, bound, collapse_ws, held, keep_only, sentences_split, spaced_words,
                                   strip_ws, without, word_tokens)
from quarry.operators import row_terms as R
from quarry.operators.topk import top_k


# ---------------------------------------------------------------------------
# normalisation
# ---------------------------------------------------------------------------

def normalized_tokens(text: Column) -> Column:
    """Lower-case, delete everything but ASCII letters, digits and whitespace,
    split on whitespace."""
    # runs of what stays are found faster than single characters that go
    clean = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z[0-9{WS}]]+"), F.lit(0)), "")
    return F.regexp_extract_all(clean, F.lit("[a-z0-9]+"), F.lit(0))


def normalized(text: Column, stopwords=L.ENGLISH_STOPWORDS) -> Column:
    """(cleaned_text, total_words, filtered_words) as a struct; every array is built once."""
    def counted(toks):
        kept = F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(*dict.fromkeys(stopwords)))
        return bound(kept, lambda k: F.struct(F.array_join(k, " ").alias("cleaned_text"), F.size(toks).alias("total_words"),
                                              F.size(k).alias("filtered_words")))
    return bound(normalized_tokens(text), counted)


def text_normalize(df: DataFrame, text_col: str = "content", stopwords=L.ENGLISH_STOPWORDS) -> DataFrame:
    """(doc_id, cleaned_text, total_words, filtered_words): stop words and
    one-character tokens dropped."""
    return df.select("doc_id", normalized(F.col(text_col), stopwords).alias("_n")).select("doc_id", "_n.*")


# ---------------------------------------------------------------------------
# statistics, readability, sentiment
# ---------------------------------------------------------------------------

def letter_words(text: Column) -> Column:
    """Runs of word characters made only of ASCII letters (``\\b[a-zA-Z]+\\b``)."""
    return az_words(text, 1, lower=False, upper_ok=True)


def statistics_cols(text: Column, n_pages: Column, words: Column | None = None, sents: Column | None = None) -> list:
    """Counts of a text; ``words`` and ``sents`` are its letter words and number of sentences where they are at hand."""
    words = letter_words(text) if words is None else words
    sents = sentence_count(text) if sents is None else sents
    wc = F.size(words)
    uniq = F.size(F.array_distinct(F.array_remove(F.split(F.lower(F.array_join(words, " ")), " "), "")))
    paras = F.size(F.filter(F.split(text, "\n\n"), lambda p: strip_ws(p) != F.lit("")))
    pages = F.greatest(n_pages, F.lit(1))
    return [
        wc.alias("word_count"), uniq.alias("unique_words"), sents.alias("sentence_count"),
        paras.alias("paragraph_count"), n_pages.alias("page_count"),
        F.floor(wc / pages).cast("int").alias("avg_words_per_page"),
        F.floor(wc / F.greatest(sents, F.lit(1))).cast("int").alias("avg_sentence_length"),
        F.round(uniq / F.greatest(wc, F.lit(1)), 3).alias("lexical_diversity"),
    ]


def text_statistics(df: DataFrame, text_col: str = "text", pages_col: str = "n_pages") -> DataFrame:
    # columns of their own: an expression with a lambda is built again wherever it is named
    x = df.select("doc_id", F.col(text_col).alias("_text"), F.col(pages_col).alias("_n"), letter_words(F.col(text_col)).alias("_words"),
                  sentence_count(F.col(text_col)).alias("_sents"))
    return x.select("doc_id", *statistics_cols(F.col("_text"), F.col("_n"), F.col("_words"), F.col("_sents")))


#: One match for each syllable of lower-case ASCII words: the beginning of a word through its first run of vowels,
#: then every later run but one that ends the word in e.
SYLLABLE = r"(?<![a-z])(?:[b-df-hj-np-tv-z]++[aeiou]*+|[aeiou]++)|[aeiou]++(?:(?=[a-z])|(?<!e))"


def syllables(words: Column) -> Column:
    """Syllables of all words (ASCII letters) of an array: a word's runs of vowels, less one if it ends in e, 1 at least."""
    return F.regexp_count(F.lower(F.array_join(words, " ")), F.lit(SYLLABLE)).cast("long")


def sentence_count(text: Column) -> Column:
    return F.size(sentences_split(text, 10))


def grade_of(words: Column, sentences: Column) -> Column:
    """Flesch-Kincaid grade of letter words and a number of sentences, one decimal; 0 when there is no sentence or word."""
    wc = F.size(words)
    grade = F.lit(0.39) * (wc / sentences) + F.lit(11.8) * (syllables(words) / wc) - F.lit(15.59)
    return F.when((wc == 0) | (sentences == 0), F.lit(0.0)).otherwise(F.round(grade, 1))


def readability_grade(text: Column) -> Column:
    return bound(F.struct(letter_words(text).alias("w"), sentence_count(text).alias("s")), lambda x: grade_of(x["w"], x["s"]))


def readability_label(grade: Column) -> Column:
    out = None
    for label, upper, _ in L.READABILITY_LEVELS:
        if upper is None:
            out = out.otherwise(label)
        else:
            out = (F.when(grade < upper, label) if out is None else out.when(grade < upper, label))
    return out


def audience_level(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for lab, _, aud in L.READABILITY_LEVELS:
        out = out.when(label == lab, aud)
    return out.otherwise("general")


def readability(df: DataFrame, text_col: str = "text") -> DataFrame:
    g = readability_grade(F.col(text_col))
    return df.select("doc_id", g.alias("grade")).select(
        "doc_id", "grade", readability_label(F.col("grade")).alias("readability"),
        audience_level(readability_label(F.col("grade"))).alias("level"))


def sentiment_cols(text: Column, pos_words=L.POSITIVE_WORDS, neg_words=L.NEGATIVE_WORDS,
                   empty_label: str = "Negative", words: Column | None = None) -> list:
    """Tone of a text; ``words`` are its ``az_words`` where they are at hand."""
    words = keep_only(az_words(text, 1) if words is None else words, [*pos_words, *neg_words])
    pos = F.size(keep_only(words, pos_words))
    neg = F.size(keep_only(words, neg_words))
    total = F.when(pos + neg == 0, F.lit(1)).otherwise(pos + neg)
    ratio = pos / total
    label = (F.when(pos + neg == 0, F.lit(empty_label)).when(ratio > 0.6, "Positive")
             .when(ratio < 0.4, "Negative").otherwise("Neutral"))
    return [pos.alias("positive_hits"), neg.alias("negative_hits"), label.alias("sentiment")]


def sentiment_desc(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for lab, desc in S.TONE:
        out = out.when(label == lab, desc)
    return out.otherwise("balanced tone")


def sentiment(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select("doc_id", *sentiment_cols(F.col(text_col))).withColumn(
        "sentiment_desc", sentiment_desc(F.col("sentiment")))


# ---------------------------------------------------------------------------
# keyword scoring: domain and document type
# ---------------------------------------------------------------------------

def doc_domain_lists():
    return [(d, kws.split()) for d, kws in L.DOC_DOMAINS]


def keyword_class(text: Column, classes, default: str, match: str = "substring") -> Column:
    """Class with the most distinct keyword hits; ties go to the first listed.

    ``match='substring'`` counts a keyword found anywhere (so 'act' hits
    'factor'); ``match='word'`` requires whole words.
    """
    def hits(x, kws):
        if match == "word":
            found = [x["low"].rlike(r"(?<![\p{L}\p{N}_])" + kw + r"(?![\p{L}\p{N}_])").cast("int") for kw in kws]
            return sum(found[1:], found[0])

        # one small expression for each class: hundreds of generated searches would not be compiled
        def count(where, some):
            return F.size(F.filter(F.array(*[F.lit(kw) for kw in some]), lambda kw: F.contains(where, kw)))
        spaced = [kw for kw in kws if " " in kw]
        single = count(x["once"], [kw for kw in kws if " " not in kw])
        return single + count(x["low"], spaced) if spaced else single

    low = F.lower(text)
    if match == "substring":
        # a keyword without a space lies inside a word, so each different word is searched once
        both = bound(low, lambda t: F.struct(t.alias("low"), F.array_join(F.array_distinct(F.split(t, " ")), " ").alias("once")))
    else:
        both = F.struct(low.alias("low"))
    best = bound(both, lambda x: F.array_max(F.array(*[
        F.struct(hits(x, kws).alias("score"), F.lit(-i).alias("neg_ord"), F.lit(name).alias("name"))
        for i, (name, kws) in enumerate(classes)])))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default))


def domain_detect(df: DataFrame, text_col: str = "text", match: str = "substring") -> DataFrame:
    return df.select("doc_id", keyword_class(F.col(text_col), doc_domain_lists(), "general", match).alias("domain"))


def document_type(df: DataFrame, text_col: str = "text", match: str = "substring") -> DataFrame:
    return df.select("doc_id", keyword_class(F.col(text_col), L.DOC_TYPES, "general", match)
                     .alias("document_type"))


# ---------------------------------------------------------------------------
# ranked term lists
# ---------------------------------------------------------------------------

def keyphrases(df: DataFrame, text_col: str = "text", top_n: int = 10, stopwords=L.ENGINE_STOPWORDS) -> DataFrame:
    """Most frequent 2- and 3-word phrases over stop-word-free ``[a-z]{3,}``
    words, every word longer than 3.  Ties: bigrams first, then first position."""
    return R.as_rows(df, R.phrases(F.col(text_col), top_n, stopwords), "doc_id", {"phrase": "phrase", "count": "count"})


def tfidf_of_documents(docs: DataFrame, pages: Column, top_n: int = 20, stopwords=L.ENGINE_STOPWORDS) -> DataFrame:
    """``tfidf_keywords`` where a document's pages are an array of its row: no exchange."""
    docs = held(docs.select("doc_id", pages.alias("_p")), F.col("_p"), "_pages")
    return R.as_rows(docs, R.tfidf(F.col("_pages"), top_n, stopwords), "doc_id", {"keyword": "keyword", "score": "score"})


def tfidf_keywords(pages: DataFrame, top_n: int = 20, stopwords=L.ENGINE_STOPWORDS, min_len: int = 4,
                   page_col: str = "page") -> DataFrame:
    """Per-document TF-IDF where every page is a row: tf = count / words on the page,
    idf = ln((N + 1) / (df + 1)) + 1 with N the document's page count; summed
    over pages.  Highest first; ties by first (page, position)."""
    words = without(az_words(F.col(page_col), min_len), stopwords)
    p = pages.select("doc_id", "page_no", "n_pages", words.alias("w")).withColumn("total", F.size("w"))
    ex = p.select("doc_id", "page_no", "n_pages", "total", F.posexplode("w").alias("pos", "word"))
    per_page = ex.groupBy("doc_id", "page_no", "word").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("pos"),
        F.first("total").alias("total"), F.first("n_pages").alias("n_pages"))
    per_doc = per_page.groupBy("doc_id", "word").agg(
        F.sum(F.col("cnt") / F.greatest(F.col("total"), F.lit(1))).alias("tf_sum"),
        F.count(F.lit(1)).alias("df"),
        F.min(F.struct("page_no", "pos")).alias("first"),
        F.first("n_pages").alias("n_pages"))
    idf = F.log((F.col("n_pages") + 1) / (F.col("df") + 1)) + 1
    scored = per_doc.withColumn("score", F.col("tf_sum") * idf)
    t = top_k(scored, "doc_id", [F.desc(F.round("score", 9)), F.col("first.page_no"), F.col("first.pos")], top_n)
    return t.select("doc_id", "rank", F.col("word").alias("keyword"), "score")


# Heading patterns: numbered ("1.2 Introduction"), ALL CAPS, or "Title like:".
HEADING = (r"(?s)^([0-9]+[.\p{Nd}]*[" + WS + r"]+[A-Z][^\n]{5,60}|[A-Z][A-Z" + WS + r"]{8,50}|"
           r"[A-Z][a-z].{5,50}:)$")


def headings(pages: DataFrame, top_n: int = 20) -> DataFrame:
    """Heading-like lines of 5-100 characters, whitespace collapsed, longer
    than 8, first occurrence per document, first ``top_n`` in page order."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", strip_ws(F.col("line")))
    ok = lines.where((F.length("line") >= 5) & (F.length("line") <= 100) & F.col("line").rlike(HEADING))
    ok = ok.withColumn("title", collapse_ws(F.col("line"))).where(F.length("title") > 8)
    first = ok.groupBy("doc_id", "title").agg(F.min(F.struct("page_no", "line_no")).alias("first"))
    t = top_k(first, "doc_id", [F.col("first.page_no"), F.col("first.line_no")], top_n)
    return t.select("doc_id", F.col("rank").alias("ord"), "title", F.col("first.page_no").alias("page"))


def headings_of_documents(docs: DataFrame, pages: Column, top_n: int = 20) -> DataFrame:
    """``headings`` where a document's pages are an array of its row: no exchange."""
    return R.as_rows(docs, R.headings(pages, HEADING, top_n), "doc_id", {"title": "title", "page": "page"}, "ord")


def term_counts_top(df: DataFrame, words: Column, top_n: int, group: str = "doc_id",
                    name: str = "term") -> DataFrame:
    """Most frequent words of each row; ties by first position."""
    return R.as_rows(df, R.top_words(words, top_n), group, {name: "term", "count": "count"})


def nlp_keywords(df: DataFrame, text_col: str = "text", top_n: int = 20, ngram=(1, 2),
                 stopwords=L.ENGLISH_STOPWORDS) -> DataFrame:
    """The ``top_n`` most frequent 1..2-grams of stop-word-free 2+ letter tokens,
    returned alphabetically (as a fitted vocabulary lists its terms)."""
    # frequency decides membership; alphabetical order breaks ties at the cut
    toks = word_tokens(F.lower(F.col(text_col)))
    return R.as_rows(df, R.common_grams(toks, top_n, ngram, stopwords, 2), "doc_id", {"term": "term", "count": "count"}, "ord")


# ---------------------------------------------------------------------------
# linguistic measures
# ---------------------------------------------------------------------------

def content_words_of(text: Column, stopwords=L.ENGINE_STOPWORDS) -> Column:
    return without(az_words(text, 3), stopwords)


def lexical_diversity_cols(text: Column, stopwords=L.ENGINE_STOPWORDS, words: Column | None = None) -> list:
    """Diversity of a text; ``words`` are its ``content_words_of`` where they are at hand."""
    words = content_words_of(text, stopwords) if words is None else words
    total = F.greatest(F.size(words), F.lit(1))
    d = F.round(F.size(F.array_distinct(words)) / total, 3)
    label = F.when(d > 0.7, "rich").when(d > 0.4, "moderate").otherwise("repetitive")
    return [F.size(words).alias("content_words"), d.alias("lex_diversity"), label.alias("vocabulary")]


def mean_sentence_words(text: Column) -> Column:
    """Words of a sentence on average; sentences are found once."""
    lens = F.transform(sentences_split(text, 10), lambda s: F.size(spaced_words(strip_ws(s))))
    return bound(lens, lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, b: a + b) / F.greatest(F.size(n), F.lit(1)))


def sentence_complexity_cols(text: Column, avg: Column | None = None) -> list:
    """Complexity of a text; ``avg`` is its ``mean_sentence_words`` where it is at hand."""
    avg = mean_sentence_words(text) if avg is None else avg
    label = F.when(avg > 25, "High").when(avg > 15, "Medium").otherwise("Low")
    return [avg.alias("avg_sentence_words"), label.alias("complexity")]


def term_density_of(text: Column, terms: Column, stopwords=L.ENGINE_STOPWORDS, content_words: Column | None = None) -> Column:
    """(keyword, density) of each of ``terms``: substring occurrences per 1000 content words.

    ``content_words`` is the number of words of three letters on that are no stop words, where it is at hand.
    """
    words = F.size(without(az_words(text, 3), stopwords)) if content_words is None else content_words
    content = F.struct(F.lower(text).alias("low"), F.greatest(words, F.lit(1)).alias("total"))

    def one(t, x):
        occ = (F.length(x["low"]) - F.length(F.replace(x["low"], t, F.lit("")))) / F.length(t)
        return F.struct(t.alias("keyword"), F.round(occ / (x["total"] / 1000.0), 2).alias("density"))
    return bound(content, lambda x: F.transform(terms, lambda t: one(t, x)))


def term_density(docs: DataFrame, terms: Column, text_col: str = "text", stopwords=L.ENGINE_STOPWORDS) -> DataFrame:
    """One row per document and term of its array ``terms``, in the array's order."""
    docs = docs.select("doc_id", F.col(text_col).alias("_text"), terms.alias("_terms"))
    return R.as_rows(docs, term_density_of(F.col("_text"), F.col("_terms"), stopwords), "doc_id", {"keyword": "keyword", "density": "density"})


def topic_coherence_of(n_pages: Column, top_terms: Column) -> Column:
    """Share of (top term, page) pairs where the page contains the term as a
    ``[a-z]{4,}`` word; 1.0 for documents of one page.

    ``top_terms`` are structs of ``row_terms.tfidf``: the ``df`` of a term is its number of pages.
    """
    hits = F.aggregate(top_terms, F.lit(0).cast("long"), lambda a, t: a + t["df"])
    return F.when(n_pages <= 1, F.lit(1.0)).when(F.size(top_terms) == 0, F.lit(0.0)).otherwise(
        F.round(hits / (F.size(top_terms) * n_pages), 3))


def topic_coherence(docs: DataFrame, pages: Column, top_n: int = 10) -> DataFrame:
    """Coherence of every document that has a page (``pages``: array of its row)."""
    docs = held(docs.select("doc_id", pages.alias("_p")), F.col("_p"), "_pages").where(F.size("_pages") > 0)
    x = docs.select("doc_id", F.size("_pages").alias("n_pages"), R.tfidf(F.col("_pages"), top_n).alias("_t"))
    return x.select("doc_id", topic_coherence_of(F.col("n_pages"), F.col("_t")).alias("coherence"))
