"""Text classifiers: ladders and labels of patterns, as conditions on a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occasions and the words that tell them; independent, so no partition.
OCCASIONS = {
    "memorial": r"(?i)\b(memory|memorial|funeral|life of|passed away|remembering|died|late|tribute|commemorating|requiem|thanksgiving for the life)\b",
    "birthday": r"(?i)\b(birthday|b'day|bday)\b",
    "wedding": r"(?i)\b(wedding|anniversary|married|marriage|ruby|golden|diamond|silver)\b",
    "first": r"(?i)\b(first|1st|circled|milestone)\b",
    "service": r"(?i)\b(thanksgiving|dedication|service|festival|evensong|matins|patronal|centenary|easter|christmas|advent|lent)\b",
    "royal": r"(?i)\b(jubilee|coronation|queen|king|royal|majesty|accession|platinum|remembrance|armistice)\b",
    "farewell": r"(?i)\b(farewell|leaving|welcome|retiring|retirement|induction)\b",
    "compliment": r"(?i)\b(celebrate|celebration|compliment|congratulations|birth of)\b",
}


def practice(method: Column) -> Column:
    """K-T1: what a free-text method stands for; the first rule that holds decides, null text is unclassified."""
    t = F.regexp_replace(F.lower(F.coalesce(method, F.lit(""))), r"[-_/]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\bcallchanges?\b", "call change"), r"\bc\.?\s?c\.?s?\b", "call change")
    has = lambda *words: _any(F.contains(t, F.lit(w)) for w in words)
    stages = has("doubles", "minor", "major", "royal", "maximus")
    several = has("spliced", "mixed", "multi ", "various", "methods") | t.rlike(r"\b\d+\s*[mv]\b") | (has("and") & stages)
    return (
        F.when(has("toll", "chim"), "tolling").when(has("round") & has("call change"), "rounds_and_call_changes").when(has("call change"), "call_changes")
        .when(has("round"), "rounds").when(several, "multiple_methods").when(has("general ringing", "service ringing"), "general").otherwise("unclassified")
    )


def _any(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def labels(text: Column, patterns: Mapping[str, str]) -> Column:
    """The names of all patterns that a text matches, in the order given; null text: none."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(p), F.lit(False)), F.lit(name)) for name, p in patterns.items()]))


def label_counts(labelled: DataFrame, column: str = "labels") -> DataFrame:
    """Rows of each label."""
    return labelled.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def label_pairs(labelled: DataFrame, column: str = "labels") -> DataFrame:
    """Rows of each pair of labels a < b that stand together; built inside a row, as its labels are few."""
    pairs = F.flatten(F.transform(column, lambda a: F.transform(F.filter(column, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return labelled.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def label_coverage(labelled: DataFrame, column: str = "labels") -> DataFrame:
    """All rows, those without a label and those with several."""
    size = F.size(column)
    return labelled.agg(F.count("*").alias("rows"), F.count_if(size == 0).alias("unclassified"), F.count_if(size > 1).alias("multi"))


def toll_count(method: Column) -> Column:
    """The number in front of an otherwise bare toll; null if the text is no counted toll."""
    return F.regexp_extract(method, r"(?i)^\s*(\d{1,3})\s+(?:half[- ]muffled\s+)?tolling\s*$", 1).try_cast("int")


#: Towns that are platforms, words of houses and of churches, names of private rings.
PLATFORMS = ("ringing room", "ding", "handbell stadium", "zoom", "discord", "in the air", "various", "various towers")
HOUSES = (
    "cottage|cottages|house|lodge|bungalow|farm|flat|terrace|vicarage|rectory|manor house|hall farm|view cottages|road|street|avenue|drive|lane|close|way|gardens|crescent|grove|walk|court|meadows|apartment"
)
CHURCHES = ("church", "cathedral", "abbey", "minster", "saint", "st", "holy", "bvm", "chapel", "campanile", "foundry", "bellfoundry", "tower")
PRIVATE = (
    "pig le tower", "reynards", "the haven", "the vicarage", "the rectory", "church house", "parish room", "parish hall", "schoolroom", "private house", "the cottage", "the bungalow", "swaledale", "southrise",
    "the stables", "beckington", "mor awelon lon derw", "lyndhurst 5 copley lane robin hood",
)


def place_text(text: Column) -> Column:
    """Lower case, 'upon' as 'on', S and St as 'saint', other signs as blanks; null: empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\bupon\b", "on"), r"\b(s|st|saint)\b", "saint")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bcity of london\b", "london"), r"[^a-z0-9\s]", " "), r"\s+", " "))


def venue(building: Column, town: Column | None = None) -> Column:
    """K-T3: why an event was rung in no tower: 'virtual', 'vessel', 'address', 'house', 'private ring'; else 'tower'."""
    b, t = place_text(building), place_text(F.lit(None).cast("string") if town is None else town)
    church = F.arrays_overlap(F.split(b, " "), F.array(*[F.lit(c) for c in CHURCHES]))
    ladder = (
        F.when(t.isin(*PLATFORMS), "virtual").when(building.isNull() | (building == ""), "tower")
        .when(b.startswith("nb ") | b.contains("narrow boat") | b.contains("narrowboat"), "vessel").when(building.rlike(r"^\d+[\w-]*\s+[A-Za-z]+"), "address")
        .when(b.rlike(rf"\b({HOUSES})\b") & ~church, "house").when(b.isin(*PRIVATE), "private ring")
    )
    return ladder.otherwise("tower")


#: What tells the occasion of a footnote, in the order that decides.
NOTES = {
    "funeral": r"(?i)\b(funeral|interment|cremat(ion|orium)|committal|prior to the funeral|following the funeral|thanksgiving (service )?(for|of) the life|celebration of the life of|service of thanksgiving for the life|memorial service)\b",
    "memorial": (
        r"(?i)\b(in (memory|memoriam|remembrance|tribute|affectionate remembrance)|remembering|passed away|died|late|loss of|lost their lives|in honour of the late|memory of|tribute to|commemorating the life|to the memory of|"
        r"in fond memory|in grateful memory|at the passing of|mark the passing|to mark the death|half[- ]muffled|fully muffled|quarter muffled|muffled ringing|muffled peal|muffled quarter|half muffled|with a heavy heart|lest we forget|their name liveth|we will remember them)\b"
    ),
    "civic": (
        r"(?i)\b(coronation|accession|proclamation|(platinum|diamond|golden|silver)\s*jubilee|her majesty|his majesty|h\.?m\.?\s+(the\s+)?(queen|king)|queen elizabeth|king charles|prince philip|duke of edinburgh|prince of wales|princess|royal|"
        r"remembrance (sunday|day)|armistice|the fallen|war memorial|holocaust memorial|mayor|lord mayor|civic|national day|national reflection|election|olympic|commonwealth games|liberation day|d-day|ve day|vj day|king's birthday|queen's birthday|yorkshire day|lincolnshire day|juneteenth|ukraine)\b"
    ),
    "birthday": r"(?i)\b(\d+(st|nd|rd|th)?\s*b(irth)?day|birthday|b['`]?day|born on this day|happy birthday|birthday compliment|birthday greetings|birthday tribute|as a birthday|birthday wishes)\b",
    "wedding": r"(?i)\b(wedding|married|marriage|nuptials|(golden|silver|ruby|diamond|platinum|sapphire|pearl|coral|tin|wooden|cotton|leather)\s+wedding|wedding anniversary|on their wedding day|following the wedding|prior to the wedding|wedding blessing|to celebrate the marriage)\b",
    "anniversary": r"(?i)\b(\d+(st|nd|rd|th)?\s*anniversary|centenary|bicentenary|tercentenary|sesquicentenary|years since|years of service|years as|years ringing|years of ringing|anniversary of the|jubilee anniversary|ordination anniversary|institution anniversary|induction anniversary|patronal anniversary|founding anniversary|anniversary of)\b",
    "seasonal": (
        r"(?i)\b(christmas|xmas|easter|advent|lent|pentecost|whitsun|whitsuntide|harvest (festival|thanksgiving)?|patronal (festival)?|dedication festival|epiphany|carol service|evensong|matins|morning service|evening service|sunday service|service ringing|midnight mass|watchnight|"
        r"new year('s)? (day|eve)?|all saints|all souls|candlemas|ash wednesday|good friday|maundy thursday|palm sunday|ascension (day)?|trinity sunday|confirmation (service)?|bell sunday|mothering sunday|harvest|carmel festival|flower festival)\b"
    ),
    "compliment": (
        r"(?i)\b(compliment(s)? to|compliment(s)? of|congratulations to|congratulations on|best wishes to|best wishes on|farewell to|welcome to|retirement of|retiring as|retiring from|leaving the|thank you to|thanks to|get well|speedy recovery|speedy return|birth of|safe arrival of|"
        r"christening of|baptism of|engagement of|graduat(ion|ing)|good luck to|welcome to new|farewell compliment|a compliment to|with congratulations|well done to|with thanks to|welcome to)\b"
    ),
    "first-performance": (
        r"(?i)\b(first (peal|quarter|qp|qp peal|inside|as conductor|in method|on handbells|online|in the method|on \d+ bells|tower peal|away from|since|at this address|on a dumbbell|blows|handbell)|1st (peal|quarter|qp|inside|as conductor|in method|on handbells|online|in the method|on \d+ bells|tower peal|blows|handbell)|"
        r"first on|1st on|first in|1st in|first as|1st as|first for|1st for|circled the (tower|circle|composition)|circled|most methods|most changes|first of|1st of|first time|1st time|first attempt|\b\d+(st|nd|rd|th)?\s*(peal|quarter|qp)\s*(together|as conductor|on the bells|in method)?\b|\b\d+th\s+together\b)\b"
    ),
    "practice": r"(?i)\b(practice (night|evening)?|quarter peal (weekend|day|month|festival|fortnight)|peal (weekend|day|festival)|striking (competition|contest)|outing|ringing course|training day|reunion|ringing room practice|focus day|focus weekend|annual reunion|qp day|qp weekend|quarter peal day|golden oldies)\b",
}
#: When a funeral or a memorial is civic, and what tells the subject.
CIVIC_FUNERAL, CIVIC_MEMORIAL = r"(?i)\b(queen|king|prince|duke|monarch|majesty|royal)\b", r"(?i)\b(war|holocaust|armistice|the fallen|reflection|covid|remembrance|queen|king|prince|duke)\b"
SUBJECTS = {
    "bells": r"(?i)\b(bells|ring of \d+|tenor|treble|rehung|rehanging|restor(ation|ed)|augmented|augmentation|recast|dumbbell|ellacombe|clapper|soundbow|new bells|old bells|peal of \d+|back \d+|front \d+|heaviest bell|church bells|tower bells|handbells|simulator|bell fund|reeves bells)\b",
    "building": r"(?i)\b(church|tower|cathedral|chapel|abbey|guildhall|parish church|minster|steeple|belfry|priory|basilica|at this address|building|hall)\b",
    "institution": r"(?i)\b(guild|association|society|branch|district|council|college|university|school|hospital|nhs|brigade|regiment|raf|rnli|scouts|charity|parish|community care|borough|navy|army|police|anzab|cccbr|central council|bellerophons|raving ringers)\b",
    "person": (
        r"(?i)\b(ringer|conductor|churchwarden|vicar|rector|priest|bishop|canon|curate|friend|husband|wife|son|daughter|father|mother|sister|brother|grandfather|grandmother|grandson|granddaughter|uncle|aunt|cousin|family|queen|king|prince|princess|duke|duchess|couple|bride|groom|"
        r"colleague|captain|tower captain|master|president|secretary|steeple keeper|he|she|his|her|him|mr|mrs|miss|ms|dr|rev|revd|sir|lady|lord)\b"
    ),
}
ABOUT_BELLS = r"(?i)\b(in memory of the (bells|tenor|old bells|ring)|bells? (rehung|restored|augmented|installed|recast|consecrated)|centenary of the bells)\b"
ABOUT_BUILDING = r"(?i)\b(centenary of the church|church centenary|dedication of the church|anniversary of the church|support of the church|church restoration)\b"
ABOUT_INSTITUTION = r"(?i)\b(for the (guild|association|society|branch|nhs|charity|school|university|regiment))\b"
CIVIC_PERSON, CIVIC_BODY = r"(?i)\b(queen|king|prince|princess|duke|duchess|monarch|majesty|mayor|councillor)\b", r"(?i)\b(council|borough|city|nation|regiment|forces|nhs|government)\b"
FULL_NAME, ON_BELLS = r"[A-Z][a-z]+ [A-Z][a-z]+", r"(?i)\b(on the|bells|dumbbell|restored|rehung)\b"


def occasion(footnote: Column) -> Column:
    """K-T2: struct occasion, subject, confidence (always high) and evidence, the text that told the occasion.

    The first of NOTES that a text has decides, but a royal funeral or a war memorial is civic, and then both texts are the evidence.
    """
    t = F.trim(F.coalesce(footnote, F.lit("")))
    has = {k: t.rlike(p) for k, p in NOTES.items()}
    told = {k: F.regexp_extract(t, p, 0) for k, p in NOTES.items()}
    royal = has["civic"] & has["funeral"] & t.rlike(CIVIC_FUNERAL)
    war = has["civic"] & ~has["funeral"] & has["memorial"] & t.rlike(CIVIC_MEMORIAL)
    kind = F.when(t == "", "none").when(royal | war, "civic")
    evidence = F.when(t == "", "empty footnote").when(royal, F.concat(told["civic"], F.lit(" / "), told["funeral"])).when(war, F.concat(told["civic"], F.lit(" ("), told["memorial"], F.lit(")")))
    for k in NOTES:
        kind, evidence = kind.when(has[k], k), evidence.when(has[k], told[k])
    kind, evidence = kind.otherwise("none"), evidence.otherwise("no occasion marker")
    s = {k: t.rlike(p) for k, p in SUBJECTS.items()}
    someone = s["person"] | t.rlike(FULL_NAME)
    by_kind = (
        F.when(kind.isin("memorial", "funeral", "birthday", "wedding", "compliment"), F.when(someone, "person").when(s["bells"], "bells").when(s["building"], "building").when(s["institution"], "institution").otherwise("person"))
        .when(kind == "civic", F.when(t.rlike(CIVIC_PERSON), "person").when(t.rlike(CIVIC_BODY), "institution").when(s["bells"], "bells").when(s["building"], "building").otherwise("institution"))
        .when(kind == "anniversary", F.when(s["bells"], "bells").when(s["building"], "building").when(s["institution"], "institution").when(someone, "person").otherwise("none"))
        .when(kind == "seasonal", F.when(s["building"], "building").when(s["person"], "person").otherwise("none"))
        .otherwise(F.when(s["bells"] & t.rlike(ON_BELLS), "bells").otherwise("none"))
    )
    subject = F.when(t == "", "none").when(t.rlike(ABOUT_BELLS), "bells").when(t.rlike(ABOUT_BUILDING), "building").when(t.rlike(ABOUT_INSTITUTION), "institution").otherwise(by_kind)
    return F.struct(kind.alias("occasion"), subject.alias("subject"), F.lit("high").alias("confidence"), evidence.alias("evidence"))


def novelty(compositions: DataFrame, calls: Column | str) -> DataFrame:
    """K-T4: known and novel for a calling, spelt with blanks or with commas in any composition's details."""
    spaced = " ".join(calls) if isinstance(calls, str) else calls
    commas = ", ".join(calls) if isinstance(calls, str) else F.replace(calls, F.lit(" "), F.lit(", "))
    hit = F.contains("details", F.lit(spaced)) | F.contains("details", F.lit(commas))
    return compositions.agg(F.count_if(hit).alias("known")).withColumn("novel", F.col("known") == 0)
