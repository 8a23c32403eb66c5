"""Dimension tables from collector configurations.

The input has one row per document: ``config_id`` and the ``config`` struct with all defaults
(:func:`linkscope.sources.configs.with_defaults`). Lists are worked on as arrays of the row, with
higher-order functions; a table is one scan that explodes the finished array at its end, and nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.sources.configs import as_boolean, text_list

DEFAULT_ENTRY_POINT = "probe"
# Fixed defaults of internet targets.
INTERNET_ROLES = ("internet",)
INTERNET_TAGS = ("external",)
PROMOTED_TAGS = ("external", "legacy-migrated")

TARGET_COLUMNS = (
    "config_id",
    "agent_id",
    "site_id",
    "position",
    "target_id",
    "fqdn",
    "target_address",
    "tests",
    "dns_servers",
    "roles",
    "tags",
    "linux_profile_id",
    "target_kind",
    "external_trace_target",
)


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def _list_or(value: Column, default: Column) -> Column:
    return F.coalesce(text_list(value), default)


def _blank(text: Column) -> Column:
    return ~F.coalesce(F.regexp_like(text, F.lit(r"\S")), F.lit(False))


def _internet_test(test: Column) -> Column:
    return F.lower(test).isin(*[name.lower() for name in schema.INTERNET_TESTS])


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


# -- targets as arrays -------------------------------------------------------


def _configured(targets: Column, enabled: Column) -> Column:
    """Internal targets as configured, with what a promotion to an internet target needs."""

    def one(item: Column, at: Column) -> Column:
        tests = text_list(item["tests"])
        chosen = F.when(F.size(F.coalesce(tests, F.array())) > 0, tests).otherwise(enabled)
        trace = F.coalesce(item["externalTraceTarget"], item["address"])
        other_trace = ~_blank(trace) & (F.lower(trace) != F.lower(F.coalesce(item["address"], F.lit(""))))
        return _struct(
            position=at,
            target_id=item["id"],
            fqdn=item["fqdn"],
            target_address=item["address"],
            tests=chosen,
            dns_servers=_list_or(item["dnsServers"], _texts()),
            roles=_list_or(item["roles"], _texts()),
            tags=_list_or(item["tags"], _texts()),
            linux_profile_id=F.coalesce(item["linuxProfileId"], F.lit("")),
            target_kind=F.lit("internal"),
            external_trace_target=trace,
            promoted=F.exists(chosen, _internet_test) | F.coalesce(other_trace, F.lit(False)),
            shares=item["shares"],
        )

    return F.transform(targets, one)


def _internal(configured: Column) -> Column:
    """The internet tests of promoted targets have moved."""

    def one(target: Column) -> Column:
        remaining = F.filter(target["tests"], lambda test: ~_internet_test(test))
        return target.withField("tests", F.when(target["promoted"], remaining).otherwise(target["tests"])).dropFields(
            "promoted", "shares"
        )

    return F.transform(configured, one)


def _promoted(configured: Column) -> Column:
    def one(target: Column) -> Column:
        name = target["target_id"]
        # Only ids up to this target, and only such ids, can collide with the new one.
        similar = F.filter(
            F.slice(configured, F.lit(1), target["position"] + 1), lambda t: F.contains(t["target_id"], F.lit("-internet"))
        )
        taken = F.transform(similar, lambda t: t["target_id"])
        candidates = F.concat(
            F.array(F.concat(name, F.lit("-internet"))),
            F.transform(
                F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(name, F.lit("-internet-"), n.cast("string"))
            ),
        )
        trace, address = target["external_trace_target"], target["target_address"]
        moved = F.filter(target["tests"], _internet_test)
        outside = F.when(_blank(trace), address).otherwise(trace)
        return _struct(
            position=target["position"],
            target_id=F.get(F.array_except(candidates, taken), F.lit(0)),
            fqdn=F.concat(F.coalesce(target["fqdn"], F.lit("")), F.lit(" Internet")),
            target_address=outside,
            tests=F.when(F.size(moved) > 0, moved).otherwise(_texts(*schema.INTERNET_TESTS)),
            dns_servers=_texts(),
            roles=_texts(*INTERNET_ROLES),
            tags=_texts(*PROMOTED_TAGS),
            linux_profile_id=F.lit(""),
            target_kind=F.lit("external"),
            external_trace_target=outside,
        )

    return F.transform(F.filter(configured, lambda t: t["promoted"]), one)


def _internet(targets: Column) -> Column:
    def one(item: Column, at: Column) -> Column:
        address = item["address"]
        return _struct(
            position=at,
            target_id=item["id"],
            fqdn=F.when(_blank(item["name"]), address).otherwise(item["name"]),
            target_address=address,
            tests=_list_or(item["tests"], _texts(*schema.INTERNET_TESTS)),
            dns_servers=_list_or(item["dnsServers"], _texts()),
            roles=_list_or(item["roles"], _texts(*INTERNET_ROLES)),
            tags=_list_or(item["tags"], _texts(*INTERNET_TAGS)),
            linux_profile_id=F.coalesce(item["linuxProfileId"], F.lit("")),
            target_kind=F.coalesce(item["targetKind"], F.lit("external")),
            external_trace_target=F.coalesce(item["externalTraceTarget"], address),
        )

    return F.transform(targets, one)


def _extension_list(extensions: Column) -> Column:
    def one(item: Column, at: Column) -> Column:
        entry_point = item["entryPoint"]
        return _struct(
            position=at,
            extension_id=item["id"],
            path=item["path"],
            entry_point=F.when(_blank(entry_point), F.lit(DEFAULT_ENTRY_POINT)).otherwise(entry_point),
            enabled=F.coalesce(as_boolean(item["enabled"]), F.lit(True)),
            allowed_targets=_list_or(item["targets"], _texts()),
            inline_script=F.coalesce(item["script"], item["scriptBlock"], item["inlineScript"]).isNotNull(),
        )

    return F.transform(extensions, one)


def _with_configured(configs: DataFrame) -> DataFrame:
    """``configured`` beside the document: the arrays made from it read it several times."""
    return configs.withColumn("configured", _configured(F.col("config.targets"), F.col("config.tests.enabled")))


def _exploded(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """One row per item of an array.

    The outer form: an inner explode adds a filter that evaluates the whole array a second time.
    """
    return rows.select(*rows.columns, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def _rows(configs: DataFrame, items: Column) -> DataFrame:
    """One row per item of an array of structs, in document order."""
    named = configs.select(
        "config_id",
        F.col("config.agent.agentId").alias("agent_id"),
        F.col("config.agent.siteId").alias("site_id"),
        items.alias("items"),
    )
    return _exploded(named, F.col("items"), "item").select("config_id", "agent_id", "site_id", "item.*")


# -- tables ------------------------------------------------------------------


def targets(configs: DataFrame) -> DataFrame:
    """Internal targets; the internet tests of promoted ones have moved."""
    return _rows(_with_configured(configs), _internal(F.col("configured"))).select(*TARGET_COLUMNS)


def promoted_targets(configs: DataFrame) -> DataFrame:
    """Internet targets made from internal ones with internet tests or an outside trace address.

    The id is ``<id>-internet``, with ``-2``, ``-3``, ... if a target up to this one has it.
    """
    return _rows(_with_configured(configs), _promoted(F.col("configured"))).select(*TARGET_COLUMNS)


def internet_targets(configs: DataFrame) -> DataFrame:
    """Configured internet targets; a missing test list means both internet tests."""
    return _rows(configs, _internet(F.col("config.internetTargets"))).select(*TARGET_COLUMNS)


def _with_all_targets(configs: DataFrame) -> DataFrame:
    """``internal``, ``internet`` and ``promoted`` beside the document."""
    return _with_configured(configs).withColumns(
        {
            "internal": _internal(F.col("configured")),
            "internet": _internet(F.col("config.internetTargets")),
            "promoted": _promoted(F.col("configured")),
        }
    )


def _everything() -> Column:
    """All targets of a row with the number of their list: internal 0, internet 1, promoted 2."""

    def numbered(name: str, number: int) -> Column:
        return F.transform(name, lambda target: target.withField("list", F.lit(number)))

    return F.concat(numbered("internal", 0), numbered("internet", 1), numbered("promoted", 2))


def all_targets(configs: DataFrame) -> DataFrame:
    """Everything a collector monitors: internal, then internet, then promoted targets."""
    return _rows(_with_all_targets(configs), _everything()).select(*TARGET_COLUMNS, "list")


def shares(configs: DataFrame) -> DataFrame:
    """One row per share of an internal target."""

    def of_target(target: Column) -> Column:
        return F.transform(
            target["shares"],
            lambda share, at: _struct(
                target_id=target["target_id"],
                position=target["position"],
                share_position=at,
                share_id=share["id"],
                share_path=share["path"],
                linux_profile_id=F.coalesce(share["linuxProfileId"], F.lit("")),
            ),
        )

    found = F.flatten(F.filter(F.transform("configured", of_target), lambda one: one.isNotNull()))
    return _rows(_with_configured(configs), found).drop("site_id")


def profiles(configs: DataFrame) -> DataFrame:
    """One row per Linux authentication profile."""
    found = F.transform(
        "config.auth.linuxProfiles",
        lambda item, at: _struct(
            position=at,
            profile_id=item["id"],
            mode=F.coalesce(item["mode"], F.lit("")),
            secret_reference=F.coalesce(item["secretReference"], F.lit("")),
        ),
    )
    return _rows(configs, found).drop("site_id")


def extensions(configs: DataFrame) -> DataFrame:
    """One row per extension with its defaults."""
    return _rows(configs, _extension_list(F.col("config.extensions"))).drop("site_id")


# -- joins -------------------------------------------------------------------


def join_auth_profile(requests: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Effective profile: that of the share, else of the target, else the current context.

    ``requests`` has ``agent_id``, ``share_profile_id`` and ``target_profile_id``. An id without
    a profile yields the error code ``LinuxProfileNotFound`` and no mode.
    """
    share, target = F.col("share_profile_id"), F.col("target_profile_id")
    wanted = F.when(~_blank(share), share).when(~_blank(target), target).otherwise(F.lit(""))
    known = (
        profile_rows.groupBy("agent_id", "profile_id")
        .agg(F.min_by("mode", "position").alias("mode"))
        .withColumn("known", F.lit(True))
    )
    joined = requests.withColumn("profile_id", wanted).join(known, ["agent_id", "profile_id"], "left")
    none = F.col("profile_id") == ""
    return joined.withColumns(
        {
            "profile_mode": F.when(none, F.lit("currentContext")).otherwise(F.col("mode")),
            "profile_error": F.when(~none & F.col("known").isNull(), F.lit("LinuxProfileNotFound")),
        }
    ).drop("mode", "known")


def _handling(test: Column, target_id: Column, extension: Column) -> dict[str, Column]:
    """How a test is run, given the first enabled extension of its name (or null)."""
    built_in = F.lower(test).isin(*[name.lower() for name in schema.BUILT_IN_TESTS])
    allowed = F.transform(extension["allowed_targets"], F.lower)
    excluded = (F.size(allowed) > 0) & ~F.array_contains(allowed, F.lower(target_id))
    missing = extension.isNull()
    nothing = F.lit(None).cast("string")
    refused = F.concat(F.lit("Extension "), test, F.lit(" is not enabled for target "), target_id, F.lit("."))
    return {
        "handling": F.when(built_in, "built-in")
        .when(missing, "skipped")
        .when(excluded, "skipped")
        .otherwise("extension"),
        "error_code": F.when(built_in, nothing)
        .when(missing, "UnsupportedProbe")
        .when(excluded, "ExtensionTargetExcluded"),
        "probe_name": F.when(built_in, nothing)
        .when(missing, "Probe.Unknown")
        .otherwise(extension["entry_point"]),
        "details": F.when(built_in, nothing)
        .when(missing, F.concat(F.lit("Probe "), test, F.lit(" is not implemented.")))
        .when(excluded, refused),
        "extension_id": F.when(~built_in, extension["extension_id"]),
    }


def join_extension(tests: DataFrame, extension_rows: DataFrame) -> DataFrame:
    """How each (target, test) is run.

    ``tests`` has ``config_id, target_id, test``. ``handling`` is ``built-in``, ``extension`` or
    ``skipped``, the latter with a code and details: no extension of that name is enabled, or
    the target is not on its list. The first enabled extension of a name counts.
    """
    enabled = (
        extension_rows.filter("enabled")
        .groupBy("config_id", F.lower("extension_id").alias("name"))
        .agg(F.min_by(F.struct("extension_id", "entry_point", "allowed_targets"), "position").alias("extension"))
    )
    joined = tests.withColumn("name", F.lower("test")).join(enabled, ["config_id", "name"], "left")
    return joined.withColumns(_handling(F.col("test"), F.col("target_id"), F.col("extension"))).drop("name", "extension")


def probe_plan(configs: DataFrame) -> DataFrame:
    """Every test of every monitored target, and how it is run."""

    def of_target(target: Column) -> Column:
        def one(test: Column) -> Column:
            named = F.filter("enabled_extensions", lambda e: F.lower(e["extension_id"]) == F.lower(test))
            return _struct(
                target_id=target["target_id"],
                target_kind=target["target_kind"],
                test=test,
                **_handling(test, target["target_id"], F.get(named, F.lit(0))),
            )

        return F.transform(target["tests"], one)

    enabled = F.filter(_extension_list(F.col("config.extensions")), lambda e: e["enabled"])
    rows = _with_all_targets(configs).withColumn("enabled_extensions", enabled)
    return _rows(rows, F.flatten(F.transform(F.concat("internal", "internet", "promoted"), of_target)))


# -- rules -------------------------------------------------------------------

_FOUND = "array<struct<place: struct<section: int, place_0: int, place_1: int, check: int>, rule: string, message: string>>"


def _broken(section: int, checks: list[tuple], *place: Column) -> Column:
    """The broken ones of some checks (condition, rule, message parts), with their place in the document."""
    first, second = [*place, F.lit(0), F.lit(0)][:2]
    found = []
    for n, (condition, rule, *message) in enumerate(checks):
        text = F.concat(
            *[F.coalesce(part, F.lit("")) if isinstance(part, Column) else F.lit(part) for part in message]
        )
        at = _struct(section=F.lit(section), place_0=first, place_1=second, check=F.lit(n))
        found.append(F.when(condition, _struct(place=at, rule=F.lit(rule), message=text)))
    return F.filter(F.array(*found), lambda one: one.isNotNull())


def _each(items: Column | str, rules: Callable[[Column, Column], Column]) -> Column:
    """The broken rules of every item of an array."""
    return F.flatten(F.transform(items, rules))


def _repeated(ids: Column, own: Column, at: Column) -> Column:
    """True where an id is not blank and stands earlier in the list as well."""
    return ~_blank(own) & (F.array_position(ids, own) <= at)


def violations(configs: DataFrame) -> DataFrame:
    """All broken rules of all documents: ``config_id, place, rule, message``.

    ``place`` sorts the way the rules are checked, so the smallest of a document is the error a
    collector would stop at. A document that is no JSON object breaks the rule ``invalidJson`` only.
    Profile modes count without regard to letter case. Settings that cannot be read as the number they
    stand for come last; a collector fails when it uses them.

    The rule names and messages below are fixed values: they are the errors a collector reports.
    """
    rows = _with_all_targets(configs).withColumns(
        {
            "profile_ids": F.transform("config.auth.linuxProfiles", lambda p: p["id"]),
            "extension_list": _extension_list(F.col("config.extensions")),
        }
    )
    # Internal, internet and promoted targets share one namespace.
    rows = rows.withColumn(
        "target_ids", F.transform(F.concat("internal", "internet", "promoted"), lambda t: t["target_id"])
    ).withColumn("extension_ids", F.transform("extension_list", lambda e: e["extension_id"]))
    readable = F.col("config").isNotNull()
    config = F.col("config")
    azure = config["publish"]["azure"]

    top = _broken(
        0,
        [
            (~readable, "invalidJson", "The configuration is no JSON object."),
            (config["schemaVersion"] != "1.0", "schemaVersion", "Only schemaVersion 1.0 is supported."),
            (readable & _blank(config["agent"]["agentId"]), "agentId", "agent.agentId is required."),
            (readable & _blank(config["agent"]["siteId"]), "siteId", "agent.siteId is required."),
            (
                readable & (F.size(config["targets"]) + F.size(config["internetTargets"]) < 1),
                "noTargets",
                "At least one target or internetTarget is required.",
            ),
        ],
    )

    def profile_rules(profile: Column, at: Column) -> Column:
        name, mode, secret = profile["id"], F.lower(F.coalesce(profile["mode"], F.lit(""))), profile["secretReference"]
        label = "Linux auth profile "
        known = [known.lower() for known in schema.PROFILE_MODES]
        return _broken(
            1,
            [
                (_blank(name), "profileId", "Each auth.linuxProfiles entry requires an id."),
                (
                    _repeated(F.col("profile_ids"), name, at),
                    "duplicateProfile",
                    "Duplicate Linux auth profile id: ", name,
                ),
                (_blank(mode), "profileMode", label, name, " requires mode."),
                (
                    ~_blank(mode) & ~mode.isin(*known),
                    "profileModeUnsupported",
                    label, name, " uses an unsupported mode.",
                ),
                (
                    (mode == "currentcontext") & ~_blank(secret),
                    "secretUnsupported",
                    label, name, " uses currentContext and must not define a secretReference.",
                ),
                (
                    mode.isin("kerberoskeytab", "usernamepassword") & _blank(secret),
                    "secretRequired",
                    label, name, " requires a secretReference.",
                ),
            ],
            at,
        )

    def unknown(profile: Column) -> Column:
        return ~_blank(profile) & ~F.coalesce(F.array_contains("profile_ids", profile), F.lit(False))

    def target_rules(target: Column, at: Column) -> Column:
        name, wanted = target["target_id"], target["linux_profile_id"]
        own = _broken(
            2,
            [
                (_blank(name), "targetId", "Each target requires an id."),
                (_repeated(F.col("target_ids"), name, at), "duplicateTarget", "Duplicate target id: ", name),
                (_blank(target["fqdn"]), "targetFqdn", "Target ", name, " requires fqdn."),
                (_blank(target["target_address"]), "targetAddress", "Target ", name, " requires address."),
                (
                    unknown(wanted),
                    "targetProfile",
                    "Target ", name, " references an unknown linuxProfileId: ", wanted,
                ),
            ],
            at,
            F.lit(-1),
        )

        def share_rules(share: Column, share_at: Column) -> Column:
            own_id, wanted = share["id"], share["linuxProfileId"]
            return _broken(
                2,
                [
                    (_blank(own_id), "shareId", "Each share for target ", name, " requires an id."),
                    (
                        _blank(share["path"]),
                        "sharePath",
                        "Share ", own_id, " for target ", name, " requires path.",
                    ),
                    (
                        unknown(wanted),
                        "shareProfile",
                        "Share ", own_id, " for target ", name, " references an unknown linuxProfileId: ", wanted,
                    ),
                ],
                at,
                share_at,
            )

        return F.concat(own, F.coalesce(_each(target["shares"], share_rules), F.array().cast(_FOUND)))

    def internet_rules(number: int, offset: Column) -> Callable[[Column, Column], Column]:
        def rules(target: Column, at: Column) -> Column:
            name = target["target_id"]
            return _broken(
                3,
                [
                    (_blank(name), "internetTargetId", "Each internetTarget requires an id."),
                    (
                        _repeated(F.col("target_ids"), name, offset + at),
                        "duplicateInternetTarget",
                        "Duplicate target or internetTarget id: ", name,
                    ),
                    (
                        _blank(target["target_address"]),
                        "internetTargetAddress",
                        "Internet target ", name, " requires address.",
                    ),
                ],
                F.lit(number),
                target["position"],
            )

        return rules

    publish = _broken(
        4,
        [
            (
                azure["enabled"] & _blank(azure["accountName"]),
                "azureAccount",
                "publish.azure.accountName is required when Azure publishing is enabled.",
            ),
            (
                azure["enabled"] & _blank(azure["containerName"]),
                "azureContainer",
                "publish.azure.containerName is required when Azure publishing is enabled.",
            ),
        ],
    )

    def extension_rules(extension: Column, at: Column) -> Column:
        name = extension["extension_id"]
        return _broken(
            5,
            [
                (
                    extension["inline_script"],
                    "inlineScript",
                    "Extensions must reference trusted local script files. Inline script content is not supported.",
                ),
                (_blank(name), "extensionId", "Each extension requires an id."),
                (
                    _repeated(F.col("extension_ids"), name, at),
                    "duplicateExtension",
                    "Duplicate extension id: ", name,
                ),
                (_blank(extension["path"]), "extensionPath", "Extension ", name, " requires a path."),
            ],
            at,
        )

    def setting_rules(setting: Column, at: Column) -> Column:
        text = ("Setting ", setting["name"], " is no whole number: ", setting["value"])
        return _broken(6, [(F.lit(True), "settingType", *text)], at)

    internal, internet = F.size("internal"), F.size("internet")
    sections = [
        top,
        _each("config.auth.linuxProfiles", profile_rules),
        _each("configured", target_rules),
        _each("internet", internet_rules(1, internal)),
        _each("promoted", internet_rules(2, internal + internet)),
        publish,
        _each("extension_list", extension_rules),
        _each("config.wrongSettings", setting_rules),
    ]
    nothing = F.array().cast(_FOUND)
    found = F.concat(*[F.coalesce(section.cast(_FOUND), nothing) for section in sections])
    broken = rows.select("config_id", found.alias("broken"))
    return _exploded(broken, F.col("broken"), "found").select("config_id", "found.*")


def first_violations(broken: DataFrame) -> DataFrame:
    """The first broken rule per document."""
    return broken.groupBy("config_id").agg(
        F.min_by("message", "place").alias("first_violation"), F.count(F.lit(1)).alias("violation_count")
    )


def valid_configs(configs: DataFrame) -> DataFrame:
    """Documents without a broken rule."""
    return configs.join(violations(configs).select("config_id"), "config_id", "left_anti")
