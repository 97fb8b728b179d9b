"""Line-level operators on files(unit, rel_path, text): everything inside one file needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values are secrets.
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "client_secret", "auth_token", "credentials")
_KEY_VALUE = r"""^\s*(?:export\s+)?["']?([A-Za-z][A-Za-z0-9_.-]*)["']?\s*[:=]\s*["']?([^"'\s,;]+)"""
_PLACEHOLDER = r"(?i)^(\$\{.*|<.*>|\*+|x+|changeme.*|example.*|placeholder.*|your[_-].*|none|null|true|false|todo.*)$"


def lines(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("unit", "rel_path")) -> DataFrame:
    """keep, line_no (from 1), line."""
    return files.select(*keep, F.posexplode(F.split(F.col(text), r"\r?\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def is_secret_line(line: Column) -> Column:
    """A key that is, or ends in "_" and, a secret's name, with a value of 8 characters or more that is no placeholder; comments do not count."""
    key = F.translate(F.lower(F.regexp_extract(line, _KEY_VALUE, 1)), "-.", "__")
    value = F.regexp_extract(line, _KEY_VALUE, 2)
    named = key.rlike(f"(^|_)({'|'.join(SECRET_KEYS)})$")
    comment = line.rlike(r"^\s*(#|//|;|--)")
    return named & (F.octet_length(value) >= 8) & ~value.rlike(_PLACEHOLDER) & ~comment


#: Names and endings of files that hold secrets whatever they say.
SENSITIVE_NAMES = (".env", ".npmrc", ".pypirc", ".netrc", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "credentials.json", "secrets.json", "secrets.yml", "secrets.yaml")
SENSITIVE_ENDINGS = ("pem", "key", "p12", "pfx")
CONFIG_ENDINGS = ("env", "properties", "yml", "yaml", "json", "toml", "ini", "conf", "cfg", "xml")


def is_sensitive(path: Column, text: Column, secret: Column) -> Column:
    """By name, ending or folder, by a private key's header, or as a configuration file with a secret line."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    ending = F.substring_index(name, ".", -1)
    sample = name.rlike("example|sample|template")
    by_name = name.isin(*SENSITIVE_NAMES) | name.startswith(".env.") | ending.isin(*SENSITIVE_ENDINGS)
    folder = low.rlike(r"(^|/)(\.ssh|\.aws)/")
    header = F.substring(text, 1, 8192).rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----")
    return (by_name & ~sample) | folder | header | (ending.isin(*CONFIG_ENDINGS) & secret)


def interpreted(c: Column) -> Column:
    """c, evaluated without code of its own: inside a higher-order function, for which Spark generates none. Long lists of
    patterns otherwise outgrow the 64 KB of a generated method, and Spark compiles in vain."""
    return F.transform(F.array(F.lit(0)), lambda _: c)[0]


def declarations(file_lines: DataFrame, rules: list[tuple[str, str, str]], language: str = "language") -> DataFrame:
    """file_lines(language, line, ...) with ordered rules (language, keyword, kind): kind and name of the first
    rule that a line of its language matches. Patterns are literals, so each is compiled once."""
    found = []
    for lang, keyword, kind in rules:
        name = F.regexp_extract("line", rf"(?:^|[^\p{{L}}\p{{N}}_$]){keyword}\s+([\p{{L}}_$][\p{{L}}\p{{N}}_$]*)", 1)
        found.append(F.when((F.col(language) == lang) & F.col("line").contains(keyword) & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    rest = [c for c in file_lines.columns if c != "line"]
    return file_lines.withColumn("__m", interpreted(F.coalesce(*found))).where("__m IS NOT NULL").select(*rest, "__m.kind", "__m.name")


def unique_line(file_lines: DataFrame, wanted: Column) -> DataFrame:
    """unit, rel_path, line_no of files in which exactly one line is wanted."""
    return file_lines.where(wanted).groupBy("unit", "rel_path").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no")).where("n = 1").drop("n")
