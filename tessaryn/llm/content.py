"""Abusive, hateful or sexual content (problem 10): weak supervision over segments.

Texts are cut into segments, equal segments are judged once. Lexicon and pattern voters of four
languages and the reviewers' labels vote on each distinct segment; a generative model estimates
from the patterns of votes how accurate each voter is and which voters repeat each other; a linear
classifier on words and word pairs is trained on the posterior labels and alone scores every segment.
A document's score is that of its worst segment.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaryn.runtime import written

#: Distinct segments that the classifier is trained on at most (taken by hash, those with a positive vote and others apart), and its hashed features.
TRAIN_ROWS, FEATURES = 20_000, 1 << 15
#: A segment is hot if it makes up more than this share of all; at most 1 / share are broadcast.
HOT_SHARE = 1 / 2000
#: Labelled documents that a segment must lie in for the reviewers to vote on it, and the shares of flagged ones that make a
#: vote. A label is on the document, so a bad vote on a segment that no other voter names needs twice as many and almost all.
REVIEWED, SAFE, BAD, SURE = 4, 0.35, 0.75, 0.9
THRESHOLD = 0.5
#: Before any data a voter is believed right in this share of its votes, as firmly as if seen so often.
ACCURACY, BELIEF = 0.9, 6.0

# Words of abuse, slurs and obscenity, without accents, by language.
INSULTS = {
    "en": "idiot moron cretin imbecile scumbag bastard bitch asshole arsehole ahole aholes dumbass dickhead motherfucker fucker wanker twat prick cunt whore slut shithead bullshitter douchebag loser parasite clown jackass fuck fucking fucker fvck fuk phuck phuk shit shits piece-of-shit scum",
    "de": "arschloch vollidiot idiot drecksack wichser hurensohn schlampe fotze missgeburt abschaum dreckschwein schweine fresse verdammtes verreck gesindel untermenschen",
    "es": "idiota imbecil gilipollas cabron puta puto mierda inutil basura escoria zorra maricon pendejo hijoputa subnormal",
    "fr": "connard connasse salaud salauds ordure abruti pute fils-de-pute encule gueule imbecile salope batard raclure",
}
SEXUAL = {
    "en": "horny tits panties undressed naked spank pussy blowjob dick boobs nude nudes masturbate bend-her-over suck lick-you lick-your touching-myself in-my-bed",
    "de": "nacktfoto ficken geile geil titten schwanz bumsen",
    "es": "follarte follar desnuda polla tetas culo chupame cachonda",
    "fr": "baiser nue seins sucer coucher-avec-toi chatte",
}
GROUPS = "immigrants? foreigners? refugees? migrants? women gays? gay-couples lesbians? travellers gypsies single-mothers disabled-people old-people muslims jews christians blacks whites asians arabs auslander fluchtlinge behinderte frauen juden moslems zigeuner schwule turken inmigrantes extranjeros refugiados mujeres gitanos discapacitados moros judios negros etrangers refugies femmes handicapes immigres juifs arabes noirs migrantes migranten".replace(" ", "|").replace("-", " ")
VILE = "rats?|cockroach(?:es)?|vermin|parasites?|leeches|animals?|subhumans?|filth|filthy|scum|breed|disease|plague|inferior|stupid|lazy|criminals?|thieves|steal|go back|locked away|get rid of|swarm|crawl|ungeziefer|schmarotzer|weggesperrt|pack|tiere|dreck|faul|ratas|animales|larguen|escoria|no sirven|sucios|ladrones|cafards|vermine|dehors|animaux|sales|voleurs|paresseux"


def _any(lexicon: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(w.replace("-", " ") for w in lexicon.split()) + r")(?:e?s)?\b")


def _is(pattern: str) -> re.Pattern:
    return re.compile(pattern)


#: Names of voters on bad and on fine segments and their patterns. With the two that follow there are at most 3 * 2^13 patterns of votes.
VOTERS: list[tuple[str, re.Pattern, int]] = [
    ("insult", _any(" ".join(INSULTS.values())), 1),
    ("sexual", _any(" ".join(SEXUAL.values())), 1),
    ("lewd_request", _is(r"picture of you (?:naked|nude)|send .*nudes?|suck my|bend (?:her|you|him) over|love to (?:spank|lick|kiss)|lick (?:you|me)|touching (?:myself|yourself)|so horny|fuck (?:you|me|her|him) on|your panties|you (?:undressed|naked)|nacktfoto|foto desnuda|toute nue|follarte|te baiser|dich .*ficken"), 1),
    ("group_vile", _is(rf"\b(?:{GROUPS})\b.*\b(?:{VILE})\b|\b(?:{VILE})\b.*\b(?:{GROUPS})\b"), 1),
    ("group_judged", _is(rf"\b(?:{GROUPS})\b (?:are|is|sind|son|sont|should|gehoren|deberian|devraient)\b|\b(?:nobody needs|no one wants|get rid of|rid of all|too many|hate|those|these) (?:all )?(?:the )?(?:{GROUPS})\b|\b(?:let|letting|allow|allowing|giving) (?:{GROUPS}) (?:to )?(?:in|vote|stay|work|drive|breed|have|own|marry)\b"), 1),
    ("threat", _is(r"\b(?:(?:smash|break|cut|slit|punch|burn) (?:her|his|your|the|down)|i know where you|you will regret|deserves? a (?:good )?beating|(?:shoot|kill|hurt|find|stab|strangle) you|come to your .* and|watch your back|ich weiss wo du|bring dich um|mach dich fertig|schlag dich|wirst es bereuen|casser la figure|te tuer|je sais ou tu|tu vas le regretter|se donde vives|te voy a|te mato|te vas a arrepentir|partirte la cara)\b"), 1),
    ("death_wish", _is(r"\b(?:drop dead|hang yourself|get cancer|go die|kill yourself|nobody would miss|wish you were dead|hope you die|verreck|krepier|sollst sterben|crever|creve|te mueras|muerete)\b"), 1),
    ("told_off", _is(r"\b(?:go to hell|shut up|crawl back|you disgust|disgusting|halt die|halt s maul|ferme ta|callate|vete al|va te faire|bunch of|you people are|ihr seid|espece d|pedazo de|own ass)\b"), 1),
    ("you_are", _is(r"\b(?:you are an?|you're an?|du bist|sie sind ein|eres un|vous etes un|tu es un|what an?)\b"), 1),
    ("lewd_address", _is(r"\b(?:your body|wearing under|hotel room|tonight|all night|babe|sweetheart|sexy|ma belle|guapa|susse|sous ta|envie de te|encima del|on your desk|your voice|bett|cama|lit)\b"), 1),
    ("speaks_of", _is(r"\b(?:policy|complaints?|reported|staff|education|clinic|insurance|pest control|invoice|surgery|medical|remarks|hospital|study|museum|film|movie|novel|song|recipe|stew|garden|training|breeding|vet)\b"), -1),
    ("animals", _is(r"\b(?:dogs?|puppy|puppies|kennel|cats?|horses?|mare|hens?|cockerel|cattle|farm)\b"), -1),
    ("business", _is(r"\b(?:application|loan|payslip|bank statement|savings|interest|instalment|enclosed|approved|bank|rent|employer|credit|direct debit|kredit|antrag|zinssatz|nomina|prestamo|solicitud|demande|releve|fiche de paie|pret|thanks|thank you|please|bitte|danke|gracias|merci)\b"), -1),
]
_CLEAN_AT = len(VOTERS)  # votes -1 where nothing above votes 1
_REVIEW_AT = _CLEAN_AT + 1  # the reviewers
N_VOTERS = _REVIEW_AT + 1

_LOOKALIKE = str.maketrans("аеорсухіѕкмтвнϲοаıɑßø", "aeopcyxiskmtbhcoaiaso")
_LEET = str.maketrans("013457@$!", "oieastasi")


def plain(s: str) -> str:
    """A segment as it sounds: lower case, no accents, look-alike letters, digits and symbols inside words as letters,
    letters set apart joined (_ before them: they may belong to the word in front), stretched letters shortened; numbers are 9."""
    s = unicodedata.normalize("NFKD", s.lower().replace("ß", "ss")).translate(_LOOKALIKE)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    s = re.sub(r"(?<=[a-z])[013457@$!]+(?=[a-z])|(?<=[a-z])[@$]+|\b[@$](?=[a-z])", lambda m: m[0].translate(_LEET), s)
    s = re.sub(r"\b([a-z]*?)[*#._]{1,3}(?=[a-z]{1,4}\b|[a-z]*ing\b)", lambda m: m[1] + ("uc" if m[1] == "f" else "i" if m[1] in ("b", "sh", "d") else "s" if m[1] == "as" else ""), s)
    s = re.sub(r"\b(?:[a-z][ .\-]){2,}[a-z]\b", lambda m: "_" + re.sub(r"[ .\-]", "", m[0]), s)
    s = re.sub(r"(?<=[a-z])[’'\-](?=[a-z])", lambda m: "" if m[0] == "-" else "'", s)
    s = re.sub(r"([a-z])\1{2,}", r"\1", s)
    s = re.sub(r"\d[\d.,:]*", "9", s)
    s = re.sub(r"[^a-z0-9'_]+", " ", s.replace("__", " "))
    return re.sub(r"(?<=\S)_|_(?=\s|$)", " ", s).strip()


def votes(text: str, reviewed: int, flagged: float) -> list[int]:
    """The voters' votes on a plain text: 1 bad, -1 fine, 0 none. ``flagged`` of the ``reviewed`` documents with the segment were flagged."""
    short = re.sub(r"([a-z])\1+", r"\1", text)
    said = {x.replace("_", "") for x in (text, text.replace(" _", ""), short, short.replace(" _", ""))}
    out = [v if any(p.search(x) for x in (said if v > 0 else said - {short})) else 0 for _, p, v in VOTERS]
    out.append(0 if any(v > 0 for v in out) else -1)
    share = flagged / reviewed if reviewed else 0
    named = any(v > 0 for v in out)
    bad = share >= BAD and (named or (reviewed >= 2 * REVIEWED and share >= SURE))
    out.append((1 if bad else -1 if share <= SAFE else 0) if reviewed >= REVIEWED else 0)
    return out


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """(log-odds of each vote, prior log-odds, weights) of a generative model by EM on vote patterns.

    Each voter has its chances of -1, 0 and 1 for bad and for fine segments. Voters correlated beyond
    what the labels explain repeat each other: their weight is one over what they repeat.
    """
    n = patterns.shape[1]
    w = np.sqrt(counts)  # common business sentences must not drown the rest
    bad, fine = (patterns > 0).sum(1), (patterns < 0).sum(1)
    post = np.where(patterns[:, _REVIEW_AT] != 0, 0.5 + 0.45 * patterns[:, _REVIEW_AT], np.clip((bad + 0.2) / (bad + fine + 0.7), 0.03, 0.97))
    weights = np.ones(n)
    for step in range(rounds):
        odds = np.zeros((n, 3))
        for v in (-1, 0, 1):
            hit = patterns == v
            p1 = (hit * (w * post)[:, None]).sum(0) + BELIEF * (ACCURACY if v > 0 else 1 - ACCURACY)
            p0 = (hit * (w * (1 - post))[:, None]).sum(0) + BELIEF * (ACCURACY if v < 0 else 1 - ACCURACY)
            odds[:, v + 1] = np.log(p1 / ((w * post).sum() + BELIEF)) - np.log(p0 / ((w * (1 - post)).sum() + BELIEF))
        odds[:, 1] = 0  # no vote says nothing
        for j, (_, _, v) in enumerate(VOTERS):  # a voter may be worthless but not the reverse of what it says
            odds[j, v + 1] = max(0, odds[j, 2]) if v > 0 else min(0, odds[j, 0])
        prior = np.log(((w * post).sum() + 1) / ((w * (1 - post)).sum() + 1))
        raw = prior + (np.take_along_axis(odds[None], (patterns + 1)[:, :, None], 2)[:, :, 0] * weights).sum(1)
        post = 1 / (1 + np.exp(-np.clip(raw, -12, 12)))
        if step == rounds // 2:
            given = [np.average(patterns, axis=0, weights=w * c + 1e-9) for c in (post, 1 - post)]
            rest = patterns - np.outer(post, given[0]) - np.outer(1 - post, given[1])
            cov = (rest * w[:, None]).T @ rest / w.sum()
            sd = np.sqrt(np.diag(cov)) + 1e-6
            weights = 1 / np.maximum(1, np.clip(cov / np.outer(sd, sd) - 0.2, 0, 1).sum(1) + 0.2)
    return odds, float(prior), weights


def posterior(patterns: np.ndarray, model) -> np.ndarray:
    odds, prior, weights = model
    raw = prior + (np.take_along_axis(odds[None], (patterns + 1)[:, :, None], 2)[:, :, 0] * weights).sum(1)
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def hashed(text: str) -> np.ndarray:
    """Feature numbers of a plain text's words, word pairs and pairs one apart."""
    t = ["^", *text.replace(" _", "").replace("_", "").split(" "), "$"]
    grams = {*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False)), *(f"{a} _ {b}" for a, b in zip(t, t[2:], strict=False))}
    return np.fromiter((zlib.crc32(g.encode()) % FEATURES for g in grams), np.int64, len(grams))


def fit_classifier(texts: list[str], target: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the constant of a logistic regression on soft labels, by adaptive gradient steps."""
    rows = [hashed(t) for t in texts]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.array([1 / np.sqrt(len(r)) for r in rows])
    w, b, g2, gb2 = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8), 1e-8
    total = weight.sum() + 1e-9
    for _ in range(steps):
        z = np.bincount(of, w[at], len(rows)) * size + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total
        g = np.bincount(at, (e * size)[of], FEATURES) + decay * w / FEATURES
        g2 += g * g
        gb2 += e.sum() ** 2
        w -= 0.8 * g / np.sqrt(g2)
        b -= 0.2 * e.sum() / np.sqrt(gb2)
    return np.append(w, b)


def predict(texts: list[str], weights: np.ndarray) -> np.ndarray:
    w, b = weights[:-1], weights[-1]
    z = np.array([w[f].sum() / np.sqrt(len(f)) + b for f in map(hashed, texts)])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: (pattern, replacement) before cutting: words set apart by dots or one to a line are joined, numbers are 9.
_JOIN = [(r"\s+(?:\.\.\.|…)\s+", " "), (r"\n(?:(?<=\S\n)(?=\S{1,30}(?:\n|\z))|(?<=\n\S{1,30}\n)(?=\S))", " "), (r"(?<![\p{L}\d])\d(?:[\d.,:/-]*\d)?", "9")]
_CUT = r"(?<=[.!?…])\s+|[\r\n\u2028\u2029]+|(?<=:)\s(?=[A-ZÄÖÜÉ])"
_MARK = r"(?i)^\s*(?:[-*>•]+\s*|(?:agent|client):\s*)*"


def segments(text: Column) -> Column:
    """The distinct segments of a text: its sentences and lines without speaker and list marks."""
    for pattern, to in _JOIN:
        text = F.regexp_replace(text, pattern, to)
    return F.array_distinct(F.filter(F.transform(F.split(text, _CUT), lambda s: F.trim(F.regexp_replace(s, _MARK, ""))), lambda s: s != ""))


def _voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [plain(s) for s in pdf["segment"]]
        v = [votes(t, r, f) for t, r, f in zip(text, pdf["reviewed"], pdf["flagged"], strict=True)]
        yield pd.DataFrame({"h": pdf["h"], "n": pdf["n"], "text": text, "votes": ["".join("-0+"[x + 1] for x in row) for row in v]})


def _patterns(texts) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in t] for t in texts], dtype=np.int64).reshape(-1, N_VOTERS)


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``h``) of every document's segments and (``h``, ``n``, ``score``) of every distinct segment. Writes tables.

    Reads back all vote patterns, of which there are at most 3 * 2^13, and ``TRAIN_ROWS`` training segments.
    """
    parts = docs.select("doc_id", F.explode(segments(F.col("text").cast("string"))).alias("segment")).withColumn("h", F.unhex(F.md5("segment")))
    parts = written(parts, "segments")
    opinion = labels.where("flagged IS NOT NULL").groupBy("doc_id").agg(F.avg("flagged").alias("_f"))
    stats = parts.join(opinion, "doc_id").groupBy("h").agg(F.count("*").alias("reviewed"), F.sum("_f").alias("flagged"))
    kinds = parts.groupBy("h").agg(F.first("segment").alias("segment"), F.count("*").alias("n"))
    kinds = kinds.join(stats, "h", "left").select("h", "n", "segment", F.coalesce("reviewed", F.lit(0)).alias("reviewed"), F.coalesce("flagged", F.lit(0.0)).alias("flagged"))
    voted = written(kinds.mapInPandas(_voted, "h binary, n bigint, text string, votes string"), "votes")

    seen = voted.groupBy("votes").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "votes").toPandas()
    if seen.empty:
        return parts.select("doc_id", "h"), voted.select("h", "n", F.lit(0.0).alias("score"))
    model = fit_label_model(_patterns(seen["votes"]), seen["k"].to_numpy())
    suspect = F.col("votes").contains("+")
    pick = [voted.where(c).orderBy(F.xxhash64("h"), "h").limit(TRAIN_ROWS // 2) for c in (suspect, ~suspect)]
    train = pick[0].union(pick[1]).select("text", "votes", "n").orderBy("text", "votes").toPandas()
    target = posterior(_patterns(train["votes"]), model)
    weights = fit_classifier(train["text"].tolist(), target, 0.2 + np.abs(2 * target - 1)).astype(np.float32)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "n": pdf["n"], "score": np.where(pdf["text"] == "", 0.0, predict(pdf["text"].tolist(), weights))})

    return parts.select("doc_id", "h"), written(voted.mapInPandas(score, "h binary, n bigint, score double"), "scores")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of every document: that of its worst segment, 0 for null and empty texts.

    Equal ids count as one document. Labels may repeat and contradict each other (their mean counts), be
    null (ignored) or empty. Whole texts are judged, whatever their length.
    """
    parts, kinds = judged(docs, labels)
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = kinds.where(F.col("n") > total * HOT_SHARE).select("h", F.col("score").alias("hot_score"))  # at most 1 / HOT_SHARE rows
    rare = kinds.where(F.col("n") <= total * HOT_SHARE).select("h", "score")
    tagged = parts.join(F.broadcast(hot), "h", "left")
    worst = tagged.where("hot_score IS NOT NULL").select("doc_id", F.col("hot_score").alias("score")).union(tagged.where("hot_score IS NULL").join(rare, "h").select("doc_id", "score"))
    worst = worst.groupBy("doc_id").agg(F.max("score").alias("score"))
    return docs.select("doc_id").distinct().join(worst, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def rates(docs: DataFrame, scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source``, ``documents``, ``flagged``, ``rate``: documents at or above the threshold by source; a null source has its own row."""
    both = docs.select("doc_id", "source").join(scores, "doc_id")
    bad = F.sum((F.col("score") >= threshold).cast("bigint"))
    return both.groupBy("source").agg(F.count("*").alias("documents"), bad.alias("flagged"), (bad / F.count("*")).alias("rate"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``lang``, ``labelled``, ``flagged``, ``found``, ``both``: the scores held against labels that nothing was trained on.

    The labels of a fifth of the labelled documents are kept from the voters; of these documents those
    count whose reviewers agree. Recall is ``both`` / ``flagged``, precision ``both`` / ``found``.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    got = scored(docs, labels.where(~held))
    truth = labels.where(held & F.col("flagged").isNotNull()).groupBy("doc_id").agg(F.avg("flagged").alias("_f")).where("_f IN (0, 1)")
    both = truth.join(docs.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id").join(got, "doc_id")
    bad, hit = F.col("_f") == 1, F.col("score") >= threshold
    return both.groupBy("lang").agg(F.count("*").alias("labelled"), F.count_if(bad).alias("flagged"), F.count_if(hit).alias("found"), F.count_if(bad & hit).alias("both"))
