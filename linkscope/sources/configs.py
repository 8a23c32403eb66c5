"""Collector configuration documents: one JSON document per agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.functions.events import is_object
from linkscope.session import shared_folder

# A list of texts may be written as a single text, a number or switch as a text: such fields are read as variants.
_LIST = _NUMBER = _SWITCH = "variant"
_TARGET = f"""id: string, fqdn: string, address: string, tests: {_LIST}, dnsServers: {_LIST}, roles: {_LIST}, tags: {_LIST},
  linuxProfileId: string, externalTraceTarget: string,
  shares: array<struct<id: string, path: string, linuxProfileId: string>>"""
CONFIG_TYPE = f"""struct<
  schemaVersion: string,
  agent: struct<agentId: string, siteId: string, spoolDirectory: string, configPollIntervalSeconds: {_NUMBER},
    cycleIntervalSeconds: {_NUMBER}, maxRuntimeMinutes: {_NUMBER}>,
  publish: struct<mode: string, format: string, csvMirror: {_SWITCH},
    azure: struct<enabled: {_SWITCH}, accountName: string, containerName: string, blobPrefix: string,
      configBlobPath: string, authMode: string, sasToken: string>>,
  tests: struct<enabled: {_LIST}, pingTimeoutMs: {_NUMBER}, pingPacketSize: {_NUMBER}, shareAccessTimeoutSeconds: {_NUMBER},
    tracerouteTimeoutSeconds: {_NUMBER}, tracerouteProbeTimeoutSeconds: {_NUMBER}, internetQualitySampleCount: {_NUMBER}>,
  auth: struct<linuxSmbMode: string, secretReference: string,
    linuxProfiles: array<struct<id: string, mode: string, secretReference: string>>>,
  targets: array<struct<{_TARGET}>>,
  internetTargets: array<struct<{_TARGET}, name: string, targetKind: string>>,
  extensions: array<struct<id: string, path: string, entryPoint: string, enabled: {_SWITCH}, targets: {_LIST},
    script: string, scriptBlock: string, inlineScript: string>>
>"""

# Fixed default settings of a collector.
DEFAULTS = {
    "schemaVersion": "1.0",
    "agent": {
        "agentId": "branch-01",
        "siteId": "default-site",
        "spoolDirectory": "data/spool",
        "configPollIntervalSeconds": 60,
        "cycleIntervalSeconds": 30,
        "maxRuntimeMinutes": 0,
    },
    "publish": {
        "mode": "local",
        "format": "jsonl",
        "csvMirror": False,
        "azure": {
            "enabled": False,
            "accountName": "",
            "containerName": "",
            "blobPrefix": "events",
            "configBlobPath": "",
            "authMode": "managedIdentity",
            "sasToken": "",
        },
    },
    "tests": {
        "enabled": ["ping", "dns", "share", "internetQuality", "traceroute"],
        "pingTimeoutMs": 3000,
        "pingPacketSize": 56,
        "shareAccessTimeoutSeconds": 15,
        "tracerouteTimeoutSeconds": 20,
        "tracerouteProbeTimeoutSeconds": 3,
        "internetQualitySampleCount": 4,
    },
    "auth": {"linuxSmbMode": "currentContext", "secretReference": ""},
}


def text_list(value: Column) -> Column:
    """A variant as a list of texts; a single text is a list of one."""
    listed = F.try_variant_get(value, "$", "array<string>")
    single = F.try_variant_get(value, "$", "string")
    return F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))


def as_number(value: Column) -> Column:
    """A variant as a whole number, as a collector reads it: from text as well, halves rounded to even.

    Null where there is no number in it, or none of 32 bits.
    """
    number = F.try_variant_get(value, "$", "string").try_cast("double")
    return F.bround(number).try_cast("int")


def as_boolean(value: Column) -> Column:
    """A variant as a switch, as a collector reads it: a number other than 0, any text but the empty one, is on."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(_missing(value), F.lit(None))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def _missing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def read_configs(
    spark: SparkSession, path: str, pattern: str = "*.json", per_line: bool = False
) -> DataFrame:
    """Documents below a folder as ``config_id`` and ``document`` (its text).

    Usually a file is a document, and its path the id. For large fleets, ``per_line`` reads
    exports with one document per line; the id is then a digest, and a repeated document
    counts once.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if per_line:
        lines = files.text(path).filter(F.regexp_like("value", F.lit(r"\S")))
        documents = lines.select(F.sha2("value", 256).alias("config_id"), F.col("value").alias("document"))
        return documents.dropDuplicates(["config_id"])
    return files.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("config_id"), F.col("value").alias("document")
    )


_PROFILE = "id: string, mode: string, secretReference: string"
_INTERNET = f"{_TARGET}, name: string, targetKind: string"
_EXTENSION = f"""id: string, path: string, entryPoint: string, enabled: {_SWITCH}, targets: {_LIST},
  script: string, scriptBlock: string, inlineScript: string"""
def computed_once(frame: DataFrame, *names: str) -> DataFrame:
    """The same rows; the named columns are computed once for each of them.

    What reads several fields of a parsed document would otherwise be merged into the projection that parses
    it, and parse it for every field. Projections are not merged across a generator of one row.
    """
    kept = [name for name in frame.columns if name not in names]
    one = frame.select(*kept, F.explode_outer(F.array(F.struct(*names))).alias("once"))
    return one.select(*kept, *[F.col("once")[name].alias(name) for name in names])


def parse_configs(documents: DataFrame, document: str = "document") -> DataFrame:
    """``document`` replaced by the ``config`` struct; null where it is no JSON object.

    A single object where a list of objects is expected counts as a list of one.
    """
    kept = [name for name in documents.columns if name not in (document, "config")]
    tree, config = F.col("tree"), F.col("config")
    parsed = documents.select(
        *kept, F.try_parse_json(document).alias("tree"), F.from_json(document, CONFIG_TYPE).alias("config")
    )
    parsed = computed_once(parsed, "tree", "config")

    def listed(path: str, lists: Column, kind: str) -> Column:
        """The list, or the single object that stands in its place."""
        single = F.try_variant_get(tree, f"$.{path}", "variant")
        alone = F.from_json(F.concat(F.lit("["), F.to_json(single), F.lit("]")), f"array<struct<{kind}>>")
        return F.when(is_object(single), alone).otherwise(lists)

    whole = config
    for name, kind in (("targets", _TARGET), ("internetTargets", _INTERNET), ("extensions", _EXTENSION)):
        whole = whole.withField(name, listed(name, config[name], kind))
    profiles = listed("auth.linuxProfiles", config["auth"]["linuxProfiles"], _PROFILE)
    whole = whole.withField("auth", config["auth"].withField("linuxProfiles", profiles))
    return parsed.select(*kept, F.when(is_object(tree), whole).alias("config"))


def _defaulted(value: Column, default: object) -> Column:
    if isinstance(default, dict):
        return F.struct(*[_defaulted(value[key], default[key]).alias(key) for key in default])
    if isinstance(default, list):
        return F.coalesce(text_list(value), F.array(*[F.lit(item) for item in default]))
    if isinstance(default, bool):
        return F.coalesce(as_boolean(value), F.lit(default))
    if isinstance(default, int):
        return F.coalesce(as_number(value), F.lit(default))
    return F.coalesce(value, F.lit(default))


def _wrong_numbers(value: Column, default: object, name: str) -> list[Column]:
    """Name and text of each setting that is there and holds no number where one is expected."""
    if isinstance(default, dict):
        found = []
        for key in default:
            found += _wrong_numbers(value[key], default[key], f"{name}.{key}" if name else key)
        return found
    if isinstance(default, bool) or not isinstance(default, int):
        return []
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    wrong = ~_missing(value) & as_number(value).isNull()
    return [F.when(wrong, F.struct(F.lit(name).alias("name"), text.alias("value")))]


def with_defaults(configs: DataFrame) -> DataFrame:
    """Every setting filled in; lists of objects that are missing become empty.

    Numbers and switches are read as a collector reads them, from text too. A number that cannot be read gets
    its default and is listed under ``wrongSettings`` (name and value). A document that could not be read stays null: it is no configuration with default settings.
    """
    config = F.col("config")
    sections = {key: _defaulted(config[key], default) for key, default in DEFAULTS.items()}

    def objects(name: str, value: Column, kind: str) -> Column:
        return F.coalesce(value, F.from_json(F.lit("[]"), f"array<struct<{kind}>>")).alias(name)

    sections["auth"] = F.struct(
        *[sections["auth"][key].alias(key) for key in DEFAULTS["auth"]],
        objects("linuxProfiles", config["auth"]["linuxProfiles"], _PROFILE),
    )
    filled = F.struct(
        *[value.alias(key) for key, value in sections.items()],
        objects("targets", config["targets"], _TARGET),
        objects("internetTargets", config["internetTargets"], _INTERNET),
        objects("extensions", config["extensions"], _EXTENSION),
        F.filter(F.array(*_wrong_numbers(config, DEFAULTS, "")), lambda one: one.isNotNull()).alias("wrongSettings"),
    )
    return computed_once(configs.withColumn("config", F.when(config.isNotNull(), filled)), "config")


def stored_configs(spark: SparkSession, configs: DataFrame) -> DataFrame:
    """The same documents, written once to the shared folder.

    For callers that need several inventory tables: from columnar files each reads just its lists, instead of
    parsing all documents again.
    """
    folder = shared_folder(spark, "configs")
    configs.write.parquet(folder)
    return spark.read.parquet(folder)
