"""Secret scans: candidates by pattern, false positives removed by a random forest, all in SQL functions.

Candidates are runs of at least 16 characters of keys and encodings with a digit, and values of at
least 8 that are assigned to a secret's name. Features of a candidate: its length, transitions
between classes of characters and between letters as in words, the share of it that dictionary words
cover, the path or address it stands in, and its neighbouring words. The forest is trained on the
driver from labelled findings, a bounded set made by `labelled_findings`, whose features come from
the same expressions; it is flattened into arrays that every row's expression walks.

The main path has no Python: splitting, matching, features and the forest are built-in functions.
Only lines with a candidate are taken apart.

Defined results: null and empty texts have no findings; each occurrence is a finding, in repeated
rows too; an empty table gives an empty result; extra columns are ignored. `word` counts the line's
parts between blanks, `at` is the candidate's place among those of its part; both and `line` from 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
NAMES = "token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?secret|key"
HARMLESS = "sha1|sha256|sha512|md5|checksum|digest|commit|hash|revision|uuid|guid|version|build|etag|phone|card|isbn|mail|example|figure|page|id"
DICTIONARY = (
    "about access account after all and app application array available backend base before between blog build cache "
    "center class client cloud code color com common component config container content context control core count custom "
    "data database date default delete demo design dev device directory document domain download edit element email enable "
    "end error event example export false field file filter first font form format framework from function get group handler "
    "header height help home host html http https icon image img import index info input install instance integration item "
    "java javascript key label large last layout left level library line link list local location log login main manager map "
    "media menu message method min mobile model module name network new node not number object offset online open option "
    "order org output package page panel parent password path plugin point position post private process product profile "
    "project property public query read release remote report request resource response result right root row schema script "
    "search section secret security select server service session set settings site size small software source spark start "
    "state static status step stream string style submit support system table tag target task template test text the theme "
    "time title token tool top tree true type update upload url user util value version video view web width window with "
    "word work www"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()

RUN = r"[A-Za-z0-9_+/=.\-]{16,}"
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?\s*[:=]"
#: A line worth taking apart.
LINE = rf"(?=[^\s]*[0-9])[A-Za-z0-9_+/=.\-]{{16,}}|(?i)(?:{NAMES})[\"']?\s*[:=]"
FEATURES = (
    "length", "digits", "uppers", "turns", "word_pairs", "covered", "distinct", "hex", "uuid", "padded", "dots", "slashes",
    "address", "extension", "named", "near_named", "harmless", "assigned", "quoted", "all_digits", "hyphens",
)


def features(finding: Column, part: Column, before: Column, before2: Column, after: Column) -> Column:
    """array<double> of FEATURES for a candidate, the part of the line it is in and the words around it."""
    n = F.greatest(F.length(finding), F.lit(1)).cast("double")
    low = F.lower(finding)
    bare = lambda pattern: F.length(finding) - F.length(F.regexp_replace(finding, pattern, ""))
    has = lambda where, pattern: F.coalesce(where.rlike(pattern), F.lit(False)).cast("double")
    kinds = F.translate(finding, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    turns = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    covered = F.length(finding) - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    pairs = F.length(finding) - F.length(F.regexp_replace(low, "|".join(PAIRS), ""))
    prefix, around = F.call_function("substring_index", part, finding, F.lit(1)), F.concat_ws(" ", before2, before, F.call_function("substring_index", part, finding, F.lit(1)))
    values = [
        n, bare("[0-9]") / n, bare("[A-Z]") / n, turns / n, pairs / n, covered / n,
        F.size(F.array_distinct(F.split(finding, ""))) / F.least(n, F.lit(40.0)),
        has(finding, "^[0-9a-f]+$|^[0-9A-F]+$"), has(finding, "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        has(finding, "=$"), bare(r"\.") / n, bare("/") / n, has(part, r"://|^www\.|@"),
        has(part, r"(?i)\.(?:png|jpe?g|gif|svg|css|js|html?|php|pdf|zip|gz|jar|py|txt|json|xml|com|org|net)\b"),
        has(prefix, rf"(?i)(?:{NAMES})[\"']?\s*[:=]?[\"']?$"), has(around, rf"(?i)\b(?:{NAMES})\b"), has(around, rf"(?i)\b(?:{HARMLESS})\b"),
        has(F.concat_ws(" ", before, prefix), r"[:=]\s*[\"']?$"), has(part, r"[\"']"), has(finding, "^[0-9.+-]+$"), bare("[-_]") / n,
    ]
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


@dataclass
class Forest:
    """Complete trees of one depth: node i has children 2i + 1 and 2i + 2; right where the feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        trees = np.arange(len(self.leaf))[None]
        while node.size and node[0, 0] < self.feature.shape[1]:
            node = 2 * node + 1 + (x[np.arange(len(x))[:, None], self.feature[trees, node]] > self.cut[trees, node])
        return self.leaf[trees, node - self.feature.shape[1]].mean(1)

    def expression(self, x: Column) -> Column:
        """The same score as a SQL expression over an array column."""
        inner, leaves = self.feature.shape[1], self.leaf.shape[1]
        flat = lambda a, kind: F.split(F.lit(",".join(map(repr, a.ravel().tolist()))), ",").cast(f"array<{kind}>")
        feature, cut, leaf = flat(self.feature, "int"), flat(self.cut, "double"), flat(self.leaf, "double")
        levels = F.sequence(F.lit(1), F.lit(int(leaves).bit_length() - 1))

        def walk(total: Column, tree: Column) -> Column:
            down = lambda node, _: 2 * node + 1 + (F.get(x, F.get(feature, tree * inner + node)) > F.get(cut, tree * inner + node)).cast("int")
            return total + F.get(leaf, tree * leaves + F.aggregate(levels, F.lit(0), down) - inner)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.leaf) - 1)), F.lit(0.0), walk) / float(len(self.leaf))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 6, tries: int = 7, seed: int = 42) -> Forest:
    """Random forest: bootstrap rows, at each node the best Gini cut among `tries` features."""
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), 1e300), np.full((trees, inner + 1), float(y.mean()))
    for t in range(trees):
        at = {0: rng.integers(0, len(y), len(y))}
        for node in range(inner):
            rows = at.pop(node, np.zeros(0, np.int64))
            best = (1e-9, 0, 1e300)
            if len(rows) > 3 and 0 < y[rows].mean() < 1:
                for f in rng.choice(x.shape[1], tries, replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    n = np.arange(1, len(v))
                    pure = lambda one, all_: one * (all_ - one) / all_
                    gain = pure(ones[-1], len(v)) - pure(ones[:-1], n) - pure(ones[-1] - ones[:-1], len(v) - n)
                    gain[v[1:] == v[:-1]] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, (v[i] + v[i + 1]) / 2)
            _, feature[t, node], cut[t, node] = best
            right = x[rows, feature[t, node]] > cut[t, node]
            at[2 * node + 1], at[2 * node + 2] = rows[~right], rows[right]
        for i in range(inner + 1):
            up = inner + i
            while not len(at.get(up, at.get(inner + i))) and up:  # an empty leaf says what its nearest filled one says
                sibling = up + 1 if up % 2 else up - 1
                if len(at.get(sibling, ())):
                    at[inner + i] = at[sibling]
                    break
                up = (up - 1) // 2
            if len(at[inner + i]):
                leaf[t, i] = y[at[inner + i]].mean()
    return Forest(feature, cut, leaf)


def labelled_findings(n: int = 3000, seed: int = 42) -> list[dict[str, str | int]]:
    """n findings with their surroundings and whether they are secrets, drawn from described kinds."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, base = digit + "abcdef", lower + upper + digit
    syllables = "tion ment the ing an re er ou ver ein la que ción en des st ha or chen keit".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    names = "token secret password api_key apikey access_key client_secret auth private_key credential".split()
    out: list[dict[str, str | int]] = []
    while len(out) < n:
        secret = rng.random() < 0.5
        before2, before, after, q = word(), word(), word(), pick(['"', "'", "", '"'])
        if secret:
            kind = int(rng.integers(6))
            body = [
                lambda: chars(pick([hexes, digit + "ABCDEF"]), int(pick([32, 40, 40, 64]))), lambda: chars(base, int(rng.integers(20, 48))),
                lambda: chars(base + "+/", 43) + "=", lambda: "AK" + chars(upper + digit, 18), lambda: pick(["ghx_", "sk_live_", "xoxb-"]) + chars(base, 32),
                lambda: ".".join(chars(base + "_-", int(k)) for k in (36, rng.integers(40, 80), 43)),
            ][kind]()
            way = rng.random()
            if way < 0.35:
                before2, before, part = pick(names), pick(["=", ":", ":="]), f"{q}{body}{q}"
            elif way < 0.7:
                part = f"{pick(names)}{pick(['=', ':'])}{q}{body}{q}"
            elif way < 0.85:
                before, part = pick(["Bearer", "Authorization:", "key", "token:"]), body
            else:
                part = f"{q}{body}{q}"
        else:
            kind = int(rng.integers(10))
            body = [
                lambda: chars(digit, int(rng.integers(16, 20))), lambda: "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: chars(hexes, int(pick([32, 40, 64]))),
                lambda: f"{word()}{rng.integers(1, 99)}@{word()}.example.com", lambda: "/".join([word() for _ in range(4)] + [f"{word()}{rng.integers(9)}.html"]),
                lambda: "_".join([pick(DICTIONARY) for _ in range(4)] + [str(rng.integers(100))]), lambda: word() + word() + word() + f".{rng.integers(1, 99)}" + "x" * 8,
                lambda: f"{pick(DICTIONARY)}{pick(DICTIONARY).title()}{pick(DICTIONARY).title()}Version{rng.integers(10)}", lambda: ".".join(str(rng.integers(1, 255)) for _ in range(6)),
                lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 28)}_{chars(digit, 8)}",
            ][kind]()
            part = body
            if kind in (1, 2):
                before = pick("commit sha256 sha1 md5 checksum uuid digest revision hash etag".split())
                part = pick([body, f"({body})", f"{before}:{body}", f"{q}{body}{q}"])
                before = pick([before, before + ":"])
            elif kind == 4:
                part = pick(["https://", "/", ""]) + body
        out.append({"finding": body, "part": part, "before": before, "before2": before2, "after": after, "secret": int(secret)})
    return out


def train(spark: SparkSession, findings: list[dict[str, str | int]] | None = None, **options: int) -> Forest:
    """Fit a forest on labelled findings; their features are computed by the same expressions as in a scan."""
    kind = "finding string, part string, before string, before2 string, after string, secret int"
    lines = [json.dumps(f) for f in findings or labelled_findings()]
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(f"[{','.join(lines)}]"), f"array<struct<{kind}>>")))
    got = rows.select(features(*map(F.col, ("finding", "part", "before", "before2", "after"))).alias("x"), "secret").collect()
    return fit(np.array([r.x for r in got]), np.array([r.secret for r in got], float), **options)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, word, at, finding, part, before, before2, after."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike(LINE))
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("line", "of")).where(F.col("of").rlike(LINE))
    words = F.split("of", r"\s+")
    lines = lines.withColumn("words", words)
    run = rf"(?=[^\s]*[0-9])({RUN})"
    sign = r"(?::=|=>|[:=])"
    value = rf"(?i)(?:{NAMES})[\"']?{sign}[\"']?([^\s\"',;]{{8,}})"
    named, signed = rf"(?i)(?:{NAMES})[\"']?[:=]*$", rf"(?i)(?:{NAMES})[\"']?{sign}$"
    # A value behind a name, or the name's sign and the value, that are words of their own.
    bare, own = r"([^\s\"',;]{8,})", rf"^{sign}[\"']?([^\s\"',;]{{8,}})"

    def places(w: Column, pattern: str) -> Column:
        """The matches with the places where they end, from the text before and between them."""
        whole = F.regexp_extract_all(w, F.lit(pattern), 0)
        part = F.regexp_extract_all(w, F.lit(pattern), 1)
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<end:int,found:string>>").alias("all"))

        def step(acc: Column, m: Column) -> Column:
            end = F.call_function("locate", m["whole"], w, acc["next"]) + F.length(m["whole"])
            return F.struct(end.alias("next"), F.concat(acc["all"], F.array(F.struct(end.alias("end"), m["part"].alias("found")))).alias("all"))

        return F.aggregate(F.zip_with(whole, part, lambda x, y: F.struct(x.alias("whole"), y.alias("part"))), start, step)["all"]

    def parts(w: Column, i: Column) -> Column:
        # A value that follows a name and a sign as words of their own counts from 8 characters on.
        before, name = F.get("words", i - 1), F.get("words", i - 2)
        apart = (before.isin("=", ":", ":=", "=>") & name.rlike(named)) | before.rlike(signed)
        # Each occurrence once: the same text at the same place is one candidate, elsewhere another.
        some = F.array_union(places(w, run), places(w, value))
        some = F.when(F.coalesce(apart, F.lit(False)), F.array_union(some, places(w, bare))).otherwise(some)
        some = F.when(F.coalesce(before.rlike(rf"(?i)(?:{NAMES})[\"']?$"), F.lit(False)), F.array_union(some, places(w, own))).otherwise(some)
        found = F.transform(some, lambda s: s["found"])
        return F.struct(i.alias("word"), w.alias("part"), before.alias("before"), name.alias("before2"), F.get("words", i + 1).alias("after"), found.alias("found"))

    some = F.filter(F.transform("words", parts), lambda s: F.size(s["found"]) > 0)
    rows = lines.select("id", "line", F.explode(some).alias("s"))
    return rows.select("id", "line", "s.word", "s.part", "s.before", "s.before2", "s.after", F.posexplode("s.found").alias("at", "finding"))


def scan(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, line, word, at, finding, score, secret for every candidate."""
    found = candidates(docs, id_col=id_col, text_col=text_col)
    x = found.withColumn("x", features(*map(F.col, ("finding", "part", "before", "before2", "after"))))
    scored = x.withColumn("score", forest.expression(F.col("x")))
    return scored.select(F.col("id").alias(id_col), "line", "word", "at", "finding", "score", (F.col("score") >= least).alias("secret"))
