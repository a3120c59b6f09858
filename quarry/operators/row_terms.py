"""Ranked terms of one document, counted inside its row.

All words of a document lie in its row already, so counting them needs no
exchange.  Most frequent terms are runs of equal strings of a sorted array
(``most_frequent``); scored terms become structs (term, place), are sorted, and
every run of one term gives its count and its first place.  Each builder returns
an array of structs, best first; ``as_rows`` turns such arrays into ranked rows.
Memory is bounded by the row, as for the word array itself.

Null text gives null, text without terms an empty array: no rows either way.
Rows that repeat a doc_id are counted each for itself.  Ties go to the first
place, as ``Counter.most_common`` has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicons as L
from quarry.functions.text import az_words, bound, collapse_ws, each, strip_ws, without


def run_starts(items: Column, *keys: str) -> Column:
    """Positions (from 0) in the bound, sorted array ``items`` where a run of equal ``keys`` begins."""
    def begins(x, i):
        last = F.get(items, i - 1)
        new = i == 0
        for k in keys:
            new = new | (x[k] != last[k])
        return F.when(new, i)
    return F.filter(F.transform(items, begins), lambda i: i.isNotNull())


def runs(items: Column, keys, body) -> Column:
    """``body(first, start, length)`` for every run of equal ``keys`` in the sorted array ``items`` (bound)."""
    return bound(run_starts(items, *keys), lambda starts: F.transform(
        starts, lambda at, i: body(F.get(items, at), at, F.coalesce(F.get(starts, i + 1), F.size(items)) - at)))


def best(ranked: Column, k: int) -> Column:
    """The ``k`` smallest structs; the leading fields are the order."""
    return F.slice(F.sort_array(ranked), 1, k)


def as_rows(df: DataFrame, arr: Column, keys, fields: dict, rank: str = "rank") -> DataFrame:
    """One row for each struct of ``arr``: ``keys``, its rank from 1, and ``fields`` (output name -> struct field)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    x = each(df.select(*keys, arr.alias("_a")), "_a", "_i", "_t")
    return x.select(*keys, (F.col("_i") + 1).alias(rank), *[F.col(f"_t.{f}").alias(name) for name, f in fields.items()])


#: A run of equal lines of a sorted text, two at least; possessive, so a long run takes no stack.
REPEATED = r"(?md)^(.++)$(?:\n\1$)++"


def most_frequent(terms: Column, k: int, in_order=None) -> Column:
    """The ``k`` most frequent strings of the bound array ``terms``, most frequent first, ties by first place: (term, count).

    Equal strings lie together in the sorted, joined array, where one regular expression finds those that repeat; the others
    count 1.  No lambda runs over all terms, and places are taken by set functions.  ``in_order`` names the array whose order
    breaks ties, of the bound ``terms`` and its sorted form.  Terms hold no line breaks.
    """
    struct = "array<struct<term:string,count:bigint>>"

    def of_run(r):
        term = F.substring_index(r, "\n", 1)
        return bound(term, lambda t: F.struct(((F.length(r) + 1) / (F.length(t) + 1)).cast("long").alias("count"), t.alias("term")))

    def ranked(x):
        order, found = x["order"], x["found"]
        # the count of the k-th term: 1 where fewer repeat
        least = F.coalesce(F.get(F.sort_array(F.transform(found, lambda f: f["count"]), asc=False), k - 1), F.lit(1).cast("long"))

        def cut(c):
            more = F.filter(found, lambda f: f["count"] > c)
            even = F.transform(F.filter(found, lambda f: f["count"] == c), lambda f: f["term"])

            def listed(m):
                names = F.transform(m, lambda f: f["term"])
                placed = bound(F.array_intersect(order, names), lambda o: F.sort_array(F.transform(m, lambda f: F.struct(
                    (-f["count"]).alias("order"), F.array_position(o, f["term"]).alias("pos"), f["term"].alias("term"), f["count"].alias("count")))))
                rest = F.when(c > 1, F.array_intersect(order, even)).otherwise(F.array_except(order, names))
                return F.concat(F.transform(placed, lambda f: F.struct(f["term"].alias("term"), f["count"].alias("count"))).cast(struct),
                                F.transform(F.slice(rest, 1, F.lit(k) - F.size(m)), lambda t: F.struct(t.alias("term"), c.alias("count"))).cast(struct))
            return bound(more, listed)
        return bound(least, cut)

    def counted(ordered):
        found = F.transform(F.regexp_extract_all(F.array_join(ordered, "\n"), F.lit(REPEATED), F.lit(0)), of_run)
        return bound(F.struct((ordered if in_order == "sorted" else terms).alias("order"), found.alias("found")), ranked)
    return bound(F.sort_array(terms), counted)


def top_words(words: Column, k: int, stopwords=()) -> Column:
    """The ``k`` most frequent words that are no stop words, ties by first place: (term, count)."""
    return bound(without(words, stopwords) if stopwords else words, lambda w: most_frequent(w, k))


def phrases(text: Column, k: int, stopwords=L.ENGINE_STOPWORDS, words: Column | None = None) -> Column:
    """The ``k`` most frequent 2- and 3-word phrases: (phrase, count).

    Words are stop-word-free ``[a-z]{3,}``, all longer than 3 in a phrase.  Ties: two words before three, then first place.
    ``words`` are the text's ``az_words`` where they are at hand.
    """
    def grams(joined, n):
        # a phrase may begin at every word: looked at ahead, then the word is passed; words that begin none leave the group empty
        return F.array_remove(F.regexp_extract_all(joined, F.lit("(?:(?=(" + " ".join(["[a-z]{4,}+"] * n) + "))|)[a-z]++ ?"), F.lit(1)), "")
    words = az_words(text, 3) if words is None else F.filter(words, lambda w: F.length(w) >= 3)
    both = bound(F.array_join(without(words, stopwords), " "), lambda j: F.concat(grams(j, 2), grams(j, 3)))
    return F.transform(bound(both, lambda g: most_frequent(g, k)), lambda t: F.struct(t["term"].alias("phrase"), t["count"].alias("count")))


def common_grams(tokens: Column, k: int, ngram=(1, 2), stopwords=(), min_len: int = 1) -> Column:
    """The ``k`` most frequent n-grams of ``tokens`` (without stop words and shorter tokens), ties by the term, given alphabetically: (term, count)."""
    def grams(t, n):
        if n == 1:
            return t
        # lists moved by one place each; the last words begin no n-gram
        moved = F.arrays_zip(*[(F.slice(t, i + 1, F.greatest(F.size(t) - n + 1, F.lit(0)))).alias(f"w{i}") for i in range(n)])
        return F.transform(moved, lambda g: F.concat_ws(" ", *[g[f"w{i}"] for i in range(n)]))

    def of(t):
        every = F.concat(*[grams(t, n) for n in range(ngram[0], ngram[1] + 1)])
        return F.sort_array(bound(every, lambda g: most_frequent(g, k, "sorted")))
    kept = F.filter(tokens, lambda t: F.length(t) >= min_len)
    return bound(without(kept, stopwords) if stopwords else kept, of)


def tfidf(pages: Column, k: int, stopwords=L.ENGINE_STOPWORDS, min_len: int = 4) -> Column:
    """The ``k`` best terms of an array of pages by TF-IDF: (order, page, pos, keyword, score, df).

    tf = count / words on the page, summed over pages; idf = ln((N + 1) / (df + 1)) + 1 with N pages.
    All words are sorted as lines "word, mark, page", where one regular expression finds the terms that repeat; only these meet a lambda.
    Terms found once score alike on a page, so its first ``k`` stand for all of them.  Only the terms kept are placed.
    """
    def scored(w):
        def of_term(run):
            def one(term, tags):
                pages_of_term = F.array_distinct(F.split(tags, "\n"))

                def found(tagged_pages):
                    def part(tag):
                        n = (F.length(tags) - F.length(F.replace(tags, tag, F.lit("")))) / F.length(tag)
                        return n / F.size(F.get(w, tag.cast("int") - 1_000_000_000))
                    tf = F.aggregate(tagged_pages, F.lit(0.0), lambda a, tag: a + part(tag))
                    score = tf * (F.log((F.size(w) + 1) / (F.size(tagged_pages) + 1)) + 1)
                    return bound(score, lambda v: F.struct(
                        (-F.round(v, 9)).alias("order"), (F.get(tagged_pages, 0).cast("int") - 1_000_000_000).alias("page"),
                        term.alias("keyword"), v.alias("score"), F.size(tagged_pages).alias("df")))
                return bound(pages_of_term, found)
            return bound(F.substring_index(run, "\x01", 1), lambda t: bound(
                F.replace(run, F.concat(t, F.lit("\x01")), F.lit("")), lambda tags: one(t, tags)))

        def placed(every):
            def cut(least):
                more = F.filter(every, lambda x: x["order"] < least)
                even = F.filter(every, lambda x: x["order"] == least)

                def first(x):
                    # of equal scores those that come first
                    names = F.transform(x["even"], lambda t: t["keyword"])
                    some = F.slice(F.array_intersect(F.flatten(w), names), 1, F.lit(k) - F.size(x["more"]))
                    return F.concat(x["more"], bound(some, lambda s: F.filter(x["even"], lambda t: F.array_contains(s, t["keyword"]))))
                return bound(F.struct(more.alias("more"), even.alias("even")), lambda x: F.transform(first(x), lambda t: F.struct(
                    t["order"].alias("order"), t["page"].alias("page"),
                    (F.array_position(F.get(w, t["page"]), t["keyword"]) - 1).cast("int").alias("pos"),
                    t["keyword"].alias("keyword"), t["score"].alias("score"), t["df"].alias("df"))))
            orders = F.sort_array(F.transform(every, lambda x: x["order"]))
            return bound(F.coalesce(F.get(orders, k - 1), F.get(F.sort_array(orders, asc=False), 0)), cut)
        lines = F.transform(w, lambda p, i: bound((i + 1_000_000_000).cast("string"), lambda tag: tagged(p, tag)))

        def all_terms(found):
            names = F.transform(found, lambda t: t["keyword"])

            def singles(p, i):
                score = F.lit(1) / F.size(p) * (F.log((F.size(w) + 1) / F.lit(2)) + 1)
                return F.transform(F.slice(F.array_except(p, names), 1, k), lambda t: bound(score, lambda v: F.struct(
                    (-F.round(v, 9)).alias("order"), i.alias("page"), t.alias("keyword"), v.alias("score"), F.lit(1).alias("df"))))
            return F.concat(found, F.flatten(F.transform(w, singles)))
        found = F.transform(runs_of_lines(lines, REPEATED_WORD), of_term)
        return bound(bound(found, all_terms), lambda every: F.sort_array(placed(every)))
    return bound(F.transform(pages, lambda p: without(az_words(p, min_len), stopwords)), scored)


def headings(pages: Column, pattern: str, k: int) -> Column:
    """The first ``k`` different heading-like lines of an array of pages: (page, line, title), pages from 1."""
    def lines(p, i):
        placed = F.transform(F.split(p, "\n"), lambda l, j: F.struct((i + 1).alias("page"), j.alias("line"), strip_ws(l).alias("text")))
        return F.filter(placed, lambda x: (F.length(x["text"]) >= 5) & (F.length(x["text"]) <= 100) & x["text"].rlike(pattern))
    titled = F.filter(F.transform(F.flatten(F.transform(pages, lines)), lambda x: F.struct(
        collapse_ws(x["text"]).alias("title"), x["page"].alias("page"), x["line"].alias("line"))), lambda x: F.length(x["title"]) > 8)
    return bound(F.sort_array(titled), lambda s: best(runs(s, ["title"], lambda f, at, n: F.struct(
        f["page"].alias("page"), f["line"].alias("line"), f["title"].alias("title"))), k))


#: Runs of lines "word, mark, number" with one word, and of lines "ten digits, mark, number" with one number of ten digits.
REPEATED_WORD = "(?md)^([^\x01\n]++)\x01\\d++$(?:\n\\1\x01\\d++$)++"  # two lines at least
OF_WORD = "(?md)^([^\x01\n]++)\x01\\d++$(?:\n\\1\x01\\d++$)*+"
OF_SENTENCE = "(?md)^(\\d{10})\x01\\d++$(?:\n\\1\x01\\d++$)*+"


def tagged(words: Column, tag: Column) -> Column:
    """Lines "word, mark, tag" of all words, as one text (empty without words)."""
    mark = F.concat(F.lit("\x01"), tag)
    return F.when(F.size(words) > 0, F.concat(F.call_function("array_join", words, F.concat(mark, F.lit("\n"))), mark)).otherwise("")


def runs_of_lines(parts: Column, pattern: str) -> Column:
    """Runs that ``pattern`` finds in the sorted lines of all texts of the array ``parts``; empty texts don't count."""
    lines = F.split(F.array_join(F.array_remove(parts, ""), "\n"), "\n")
    return F.regexp_extract_all(F.array_join(F.sort_array(lines), "\n"), F.lit(pattern), F.lit(0))


def scored_sentences(sentences: Column, words_of, page_words: Column, k: int, stopwords=()) -> Column:
    """The ``k`` sentences whose words are most frequent on the page, on average: (order, sentence, score).

    ``words_of`` gives a sentence's words; stop words don't count.  Words of the page (tag 0) and of its sentences (their ten-digit number)
    are sorted together as lines; the page's own open each run and count it, and the counts return to the sentences by a second sort.
    Ties: larger sentence text first.  Words hold no line breaks or marks (U+0001).
    """
    kept = (lambda w: without(w, stopwords)) if stopwords else (lambda w: w)

    def of(sents):
        own = bound(kept(page_words), lambda w: tagged(w, F.lit("0")))
        theirs = F.transform(sents, lambda x, i: bound(kept(words_of(x)), lambda w: tagged(w, (i + 1_000_000_000).cast("string"))))

        def counts(run):
            """Lines "sentence, mark, count of the word on the page"."""
            def spread(tags):
                def lines(at):
                    count = F.concat(F.lit("\x01"), F.floor((at - 1) / 2).cast("string"))
                    return F.when(at > 0, F.concat(F.replace(F.substring(tags, at, F.length(tags)), F.lit("\n"), F.concat(count, F.lit("\n"))), count)).otherwise("")
                return bound(F.instr(tags, "1"), lines)
            return bound(F.replace(run, F.concat(F.substring_index(run, "\x01", 1), F.lit("\x01")), F.lit("")), spread)

        def mean(run):
            number = F.substring(run, 1, 10)
            return bound(F.split(F.replace(run, F.concat(number, F.lit("\x01")), F.lit("")), "\n"), lambda f: F.struct(
                (number.cast("int") - 1_000_000_000).alias("s"),
                (F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) / F.size(f)).alias("score")))

        def ranked(means):
            # a sentence without words scores 0
            zeros = F.transform(F.array_except(F.sequence(F.lit(0), F.size(sents) - 1), F.transform(means, lambda x: x["s"])),
                                lambda i: F.struct(i.alias("s"), F.lit(0.0).alias("score")))
            every = F.transform(F.concat(means, zeros), lambda x: F.struct(
                F.round(x["score"], 9).alias("order"), F.get(sents, x["s"]).alias("sentence"), x["score"].alias("score")))
            return F.slice(F.sort_array(every, asc=False), 1, k)
        words = runs_of_lines(F.concat(F.array(own), theirs), OF_WORD)
        means = F.transform(runs_of_lines(F.transform(words, counts), OF_SENTENCE), mean)
        return F.when(F.size(sents) > 0, bound(means, ranked))
    return bound(sentences, of)
