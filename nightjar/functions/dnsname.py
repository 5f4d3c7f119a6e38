"""DNS name functions: normalise, public-suffix split, label entropy.

The public-suffix split is a join, not a per-row library call: every name
is cut into its right-hand label suffixes, each suffix is looked up in the
rule table with a hash join, and the longest match (or an exception) wins.
The rule table is a fixed reference list (a few thousand rules at most),
so it is broadcast after a row-count check; the big side never shuffles.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entropy is compared and stored rounded to 14 places as DECIMAL(16,14), so
# last-bit differences between log2 implementations never flip a threshold.
ENTROPY_TYPE = T.DecimalType(16, 14)

# The published list has some ten thousand rules; what is longer is no such list.
MAX_RULES = 200_000


def normalise_qname(c: Column) -> Column:
    """Strip surrounding whitespace, then trailing dots, then lower-case."""
    stripped = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.lower(F.regexp_replace(stripped, r"\.+$", ""))


def shannon_entropy(s: Column) -> Column:
    """Shannon entropy of ``s`` in bits per character; empty string is 0.

    The count of each distinct character is ``length(s) - length(replace(s,
    ch, ''))``; terms are summed in first-occurrence order. Works on any
    string Column, including a lambda variable inside ``transform``. Each
    character is counted once, before its share is used twice.
    """
    n = F.length(s)
    shares = F.transform(F.array_distinct(F.split(s, "")), lambda ch: (n - F.length(F.replace(s, ch, F.lit("")))) / n)
    return (F.when(s.isNull(), F.lit(None).cast("double"))
            .when(n == 0, F.lit(0.0))
            .otherwise(F.aggregate(shares, F.lit(0.0).cast("double"), lambda acc, p: acc - p * F.log2(p))))


def to_entropy_decimal(c: Column) -> Column:
    return F.round(c, 14).cast(ENTROPY_TYPE)


# ---------------------------------------------------------------- suffix rules

@dataclass(frozen=True)
class SuffixRules:
    """Rule table (rule_key, is_normal, is_wild, is_exc, depth) with its size
    and deepest rule, known up front so name jobs plan without extra scans."""
    df: DataFrame
    count: int
    max_depth: int


def _forms(rule: str) -> set[str]:
    """A rule in Unicode and in ``xn--`` form: names come in either."""
    mark = rule[:len(rule) - len(rule.lstrip("!*."))]
    labels = rule[len(mark):].split(".")
    try:
        ascii_form = ".".join(x.encode("idna").decode() for x in labels)
        return {rule, mark + ascii_form, mark + ".".join(x.encode().decode("idna") for x in ascii_form.split("."))}
    except UnicodeError:
        return {rule}


def suffix_rules(spark: SparkSession, rules: list[str]) -> SuffixRules:
    """Rule table from list-syntax strings ("*." marks a wildcard rule, "!" an
    exception). There is no default: without the full list every other suffix
    would be taken for a registrable domain."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules: not a public suffix list")
    both = sorted({f for r in rules for f in _forms(r.strip().lower())})
    raw = spark.createDataFrame([(r,) for r in both], "line string")
    keys = {r.lstrip("!").removeprefix("*.") for r in both}
    return SuffixRules(_rules_from_lines(raw), len(keys), max((k.count(".") + 1 for k in keys), default=0))


def rules_from_table(df: DataFrame) -> SuffixRules:
    """Wrap a rule table, measuring it with one small aggregate."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).first()
    return SuffixRules(df, st["n"], st["d"] or 0)


def load_suffix_rules(spark: SparkSession, path: str, include_private: bool = False) -> SuffixRules:
    """Read a public-suffix list file (standard syntax) with Spark.

    Lines are ``//`` comments, blank, or one rule as the first whitespace
    token. By default only the ICANN section is used, i.e. the lines between
    the ``===BEGIN ICANN DOMAINS===`` and ``===END ICANN DOMAINS===`` markers;
    files without markers are read whole. The list is a reference list of
    bounded size, so its rules come to the driver.
    """
    rules, inside, marked = [], True, False
    for line in (r.value.strip() for r in spark.read.text(path).limit(MAX_RULES + 1).collect()):
        if "===BEGIN ICANN DOMAINS===" in line and not include_private:
            rules, inside, marked = [], True, True
        elif "===END ICANN DOMAINS===" in line and not include_private:
            inside = False
        elif inside and line and not line.startswith("//"):
            rules.append(line.split()[0])
    if not rules:
        raise ValueError(f"{path} holds no suffix rules")
    return suffix_rules(spark, rules)


def _rules_from_lines(lines: DataFrame) -> DataFrame:
    tok = F.split(F.trim(F.col("line")), r"\s+").getItem(0)
    rules = (lines.select(F.lower(tok).alias("rule"))
             .filter((F.col("rule") != "") & ~F.col("rule").startswith("//")))
    kind = (F.when(F.col("rule").startswith("!"), F.lit("e"))
            .when(F.col("rule").startswith("*."), F.lit("w"))
            .otherwise(F.lit("n")))
    key = (F.when(F.col("rule").startswith("!"), F.expr("substring(rule, 2)"))
           .when(F.col("rule").startswith("*."), F.expr("substring(rule, 3)"))
           .otherwise(F.col("rule")))
    keyed = rules.select(key.alias("rule_key"), kind.alias("kind"))
    return (keyed.groupBy("rule_key")
            .agg(F.max(F.col("kind") == "n").alias("is_normal"),
                 F.max(F.col("kind") == "w").alias("is_wild"),
                 F.max(F.col("kind") == "e").alias("is_exc"))
            .withColumn("depth", F.size(F.split("rule_key", r"\."))))


def with_name_parts(df: DataFrame, rules: SuffixRules | DataFrame, qname: str = "qname",
                    domain_col: str = "registrable_domain",
                    entropy_col: str = "label_entropy") -> DataFrame:
    """Add the registrable domain and the max label entropy for ``qname``.

    For each suffix depth k up to the deepest rule, the last k labels are
    looked up in the rule table with a left hash join. Exception rules win
    (suffix is the rule minus its first label); otherwise the longest normal
    or wildcard match gives the suffix. With no match there is no suffix:
    the name is its own domain and every label counts. A bare suffix is its
    own domain with no labels (entropy 0).
    """
    if isinstance(rules, DataFrame):
        rules = rules_from_table(rules)
    max_depth = rules.max_depth
    small = rules.count <= 2 * MAX_RULES        # both forms
    rules = rules.df
    labels = F.split(F.col(qname), r"\.")
    cols = df.columns
    out = df.withColumn("__labels", labels).withColumn("__n", F.size("__labels"))
    exc_terms, best_terms = [], []
    for k in range(1, max_depth + 1):
        r = rules.select(F.col("rule_key").alias(f"__k{k}"),
                         F.col("is_normal").alias(f"__nm{k}"),
                         F.col("is_wild").alias(f"__wd{k}"),
                         F.col("is_exc").alias(f"__ex{k}"))
        r = F.broadcast(r) if small else r
        cand = F.when(F.col("__n") >= k, F.array_join(F.slice("__labels", -k, k), "."))
        out = out.withColumn(f"__c{k}", cand)
        out = out.join(r, out[f"__c{k}"] == r[f"__k{k}"], "left")
        exc_terms.append(F.when(F.col(f"__ex{k}"), F.lit(k - 1)))
        best_terms.append(F.when(F.col(f"__nm{k}"), F.lit(k)))
        best_terms.append(F.when(F.col(f"__wd{k}") & (F.col("__n") >= k + 1), F.lit(k + 1)))

    def greatest(terms):
        if not terms:
            return F.lit(None).cast("int")
        return terms[0] if len(terms) == 1 else F.greatest(*terms)

    out = out.withColumn("__sl", F.coalesce(greatest(exc_terms), greatest(best_terms), F.lit(0)))
    sl, n = F.col("__sl"), F.col("__n")
    domain = (F.when((sl == 0) | (sl >= n), F.col(qname))
              .otherwise(F.array_join(F.slice("__labels", -(sl + 1), sl + 1), ".")))
    nonempty = lambda a: F.filter(a, lambda x: x != "")
    kept = (F.when(sl == 0, nonempty(F.col("__labels")))
            .when(sl >= n, F.array().cast("array<string>"))
            .otherwise(nonempty(F.slice("__labels", 1, n - sl))))
    ent = F.coalesce(F.array_max(F.transform(kept, shannon_entropy)), F.lit(0.0))
    return out.select(*cols, domain.alias(domain_col), to_entropy_decimal(ent).alias(entropy_col))
