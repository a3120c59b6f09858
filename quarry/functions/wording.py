"""Every sentence the reports print, in one place.

Templates have ``{slots}``.  ``said`` fills them with Spark columns,
``said_sql`` with SQL expressions, so operators and their oracle SQL read the
same words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(template: str):
    """(literal, slot or None) pairs in order."""
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        yield template[at:m.start()], m[1]
        at = m.end()
    yield template[at:], None


def said(template: str, **slots) -> Column:
    out = []
    for text, slot in _parts(template):
        if text:
            out.append(F.lit(text))
        if slot:
            v = slots[slot]
            out.append(v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*out)


def said_sql(template: str, **slots) -> str:
    out = []
    for text, slot in _parts(template):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        if slot:
            out.append(f"({slots[slot]})")
    return " || ".join(out)


# ---- columns ----

COLUMN = {
    "id": "{label} names the rows ({distinct} different values) and is left out of statistics. {missing}",
    "span": "{label} runs from {first} to {last}, {days} days in all. {missing}",
    "time": "{label} holds dates or times. {missing}",
    "numeric": "{label} lies between {min} and {max}; mean {mean}, standard deviation {std}. {shape} {missing}",
    "text": "{label} has {distinct} values, most often {top}. The commonest one fills {share}% of the rows. {missing}",
}
SHAPE = {"right": "A few values are far above the rest.", "left": "A few values are far below the rest.",
         "even": "Neither end has a long tail."}
MISSING = {"none": "Every row has a value.", "some": "{pct}% of the rows have no value."}

# ---- tone of a text ----

TONE = [("Positive", "words of approval outnumber the others"), ("Negative", "words of warning outnumber the others"),
        ("Neutral", "neither approval nor warning stands out")]

# ---- outliers ----

ANOMALY = "{count} of {total} {entity} stand out ({rate}%), severity {severity}. {advice}"
IQR = "{count} of {total} rows lie beyond the quartile fences ({rate}%), severity {severity}. {advice}"
ENTITIES = {"real_estate": "property rows", "sales": "sales rows", "healthcare": "patient rows", "finance": "transaction rows",
            "logistics": "shipment rows", "generic": "rows"}
ADVICE = {"low": "Hardly anything needs a second look.", "moderate": "Look at the flagged ones before relying on averages.",
          "high": "Find out why so many differ before using the table."}
HEALTH_NOTE = " Compare flagged patients with their group first."
#: entity, then what to say at low, moderate and high severity
ANOMALY_PHRASES = {d: (e, ADVICE["low"], ADVICE["moderate"], ADVICE["high"]) for d, e in ENTITIES.items()}

# ---- tables ----

#: what rows are about, what their groups are
TABLE_SUBJECTS = {"real_estate": ("properties", "kinds of property"), "sales": ("sales", "lines of business"),
                  "healthcare": ("patients", "groups of patients"), "finance": ("transactions", "kinds of transaction"),
                  "logistics": ("shipments", "kinds of shipment"), "generic": ("records", "kinds of record")}
TABLE = {
    "size": "{rows} rows, {columns} columns, about {subject}.",
    "measures": "Numbers to look at: {names}.",
    "no_measures": "No column holds plain numbers.",
    "groups": "Rows fall into groups by {names}.",
    "no_groups": "No column sorts the rows into {groups}.",
    "time": "{name} puts the rows in time.",
    "no_time": "Nothing puts the rows in time.",
    "cleaned": "Repeated rows were dropped and gaps filled beforehand.",
    "do_measures": "Chart {names} first.",
    "do_no_measures": "Count rows first; there are no numbers to chart.",
    "do_groups": "Split every figure by {names}.",
    "do_time": "Plot figures against {name}.",
    "do_no_time": "Correlate the numeric columns with each other.",
    "many": "Sum up by group; single rows are too many to read.",
    "few": "With fewer than 200 rows, treat differences as hints.",
    "outliers_high": "Check the outliers before anything else.",
    "outliers_some": "Check the outliers once the main figures are known.",
    "outliers_few": "Outliers are too few to matter.",
}
TABLE_RECOMMENDATIONS = {
    "real_estate": ["Compare prices per area within a district.", "List offers far from their district's median."],
    "sales": ["Rank products by their share of turnover.", "Compare customers by order size and frequency."],
    "healthcare": ["Compare readings with the reference range of the age group.", "Follow groups over time, not single patients."],
    "finance": ["Reconcile totals per account.", "Look for amounts just under a limit."],
    "logistics": ["Compare planned and actual times per route.", "Find the legs where delays begin."],
}

# ---- documents ----

_SUBJECT = {"academic": "Course material", "research": "A research paper", "business": "A business report", "legal": "A legal text",
            "medical": "A medical text", "security": "A text on computer security", "financial": "A financial report",
            "technical": "A technical manual", "news": "News", "general": "A text"}
_USE = {"academic": "Serves to prepare a class or an exam at {level} level.", "research": "Serves to survey the field.",
        "business": "Serves to brief those who decide.", "legal": "Serves as a first reading before counsel's.",
        "medical": "Serves as a first reading before a clinician's.", "security": "Serves to plan defences.",
        "financial": "Serves to follow the figures.", "technical": "Serves those who build or run it.",
        "news": "Serves to catch up on events.", "general": "Serves as an overview."}
DOC_SUMMARIES = {d: f"{s} of {{pages}} pages and {{words}} words about {{topics}}, in {{sections}} sections. "
                    f"Words that mark it: {{keywords}}. Reading it is {{readability}}. {_USE[d]}" for d, s in _SUBJECT.items()}
_FACTS = ["Length: {pages} pages, {words} words, {density} to a page.", "Sections: {sections}.", "Marking words: {keywords}.",
          "Reading level: {readability}."]
DOC_INSIGHTS = {
    "academic": [*_FACTS, "Themes: {topics}."],
    "research": [*_FACTS, "Tone: {sentiment} ({sentiment_desc})."],
    "business": [*_FACTS, "Tone: {sentiment} ({sentiment_desc})."],
    "security": [*_FACTS, "Tone: {sentiment} ({sentiment_desc})."],
    "legal": [*_FACTS, "Each clause binds; the wording counts."],
    "medical": [*_FACTS, "Terms are used in their clinical sense."],
    "general": [*_FACTS, "Themes: {topics}."],
}
_READ = ["Begin with {top_section}.", "Search for {top3_keywords}."]
DOC_RECOMMENDATIONS = {
    "academic": [*_READ, "Make a card of each marking word.", "Plan for {density} words a page.", "Read a second source on {top_topic}."],
    "research": [*_READ, "Check how the results were obtained.", "Look up who else wrote on {top_topic}.", "Mind the {sentiment} tone."],
    "business": [*_READ, "Name someone for each open point.", "Ask for the figures behind {top_topic}.", "Mind the {sentiment} tone."],
    "security": [*_READ, "Test your own systems for {top_topic}.", "Update the policy where it is silent.", "Repeat the test after a fix."],
    "legal": [*_READ, "List duties with their deadlines.", "Ask counsel about {top_topic}.", "Note which law governs."],
    "medical": [*_READ, "Compare with the current guideline on {top_topic}.", "Ask a specialist where doses differ.", "Explain terms to patients."],
    "general": [*_READ, "Read the longest pages first.", "Find other texts on {top_topic}.", "Keep the overview with the text."],
}
EMPTY_DOC = {
    "document_type": "unknown",
    "executive_summary": "The file holds no text that could be read.",
    "key_insights": "There is nothing to report on.",
    "recommendations": "Try the file again, or another copy of it.",
    "sentiment": "Neutral",
    "readability": "Unknown",
}
LINGUISTIC = ("Terms that weigh most: {terms}. Diversity of words: {diversity} ({vocabulary}). Sentences are {complexity}, {length} words on "
              "average. Pages share vocabulary to {coherence} ({strength}). Most frequent of the terms: {term}, {density} times in 1000 words.")

# ---- pages ----

PAGE = {"heading": "On '{heading}'.", "words": "{words} words.", "keywords": "Terms: {keywords}.", "empty": "Page {page}: {words} words."}
