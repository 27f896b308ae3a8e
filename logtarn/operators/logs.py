"""Normalisation of syslog records.

Each step maps a DataFrame to a DataFrame and adds columns only, so the same functions serve
batch and streaming and the whole chain stays in the stage of the scan: no shuffle, no split into
one branch per service.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtarn.functions.json_text import is_text, object_fields, only_value
from logtarn.functions.logfmt import logfmt_json, plain_json
from logtarn.functions.text import strip_ansi, word_after
from logtarn.schemas import LOG_FIELDS

# Incoming field and the name it is stored under.
RENAMED = {
    "timestamp": "ts",
    "appname": "service",
    "severity": "level",
    "message": "msg",
}
# Service names that have a route of their own, and the route's name.
ROUTES = {
    "registry": "registry",
    "coresmd-coredns": "coresmd_coredns",
    "coresmd-coredhcp": "coresmd_coredhcp",
    "smd": "smd",
    "hydra": "hydra",
    "opaal": "opaal",
    "step-ca": "step_ca",
    "cloud-init-server": "cloud_init_server",
}
UNMATCHED = "_unmatched"
JSON_SERVICES = ("opaal",)
LOGFMT_SERVICES = tuple(name for name in ROUTES if name not in JSON_SERVICES)
# Fields taken over from the parsed message. request_user is not among them.
PROMOTED = ("request_uri", "request_id", "component_id", "node_id", "trace_id", "xname")
# Field searched for in the message text, and the word that introduces it.
SEARCHED = {"node_id": "nid", "xname": "xname"}
# Fields that start out null.
DOMAIN_FIELDS = (
    "xname", "component_id", "node_id", "trace_id", "request_id", "request_uri", "request_user",
)

NOT_JSON = "unable to parse message as JSON"
NOT_LOGFMT = "unable to parse message as logfmt"


def prepare(landed: DataFrame) -> DataFrame:
    """Rename the syslog fields, add the domain fields as nulls, strip terminal escapes.

    ``data`` is JSON text from the start, so it never has to be encoded. Other syslog fields are
    carried along unchanged.
    """
    null = F.lit(None).cast("string")
    known = {
        "ts": F.col("timestamp"),
        "service": F.col("appname"),
        "host": F.col("host"),
        "level": F.col("severity"),
        "msg": strip_ansi(F.col("message")),
        "data": F.lit("{}"),
        "parse_error": null,
        **{name: null for name in DOMAIN_FIELDS},
    }
    carried = [c for c in landed.columns if c not in RENAMED and c not in LOG_FIELDS]
    return landed.select(
        *[known[name].alias(name) for name in LOG_FIELDS if name in known], *carried
    )


def route_name(service: Column) -> Column:
    """The route of a service; services without one share the unmatched route."""
    name = F.lit(UNMATCHED)
    for program, route in ROUTES.items():
        name = F.when(service == program, F.lit(route)).otherwise(name)
    return name


def route(records: DataFrame) -> DataFrame:
    """Add the ``route`` of each record."""
    return records.withColumn("route", route_name(F.col("service")))


def sanitize(records: DataFrame) -> DataFrame:
    """Parse ``msg`` into ``data`` in the manner of its route, or note why it could not be.

    Both parsers sit in one conditional expression: each row is parsed at most once, and the
    records of all routes stay in one DataFrame.
    """
    service, msg = F.col("service"), F.col("msg")
    is_json = service.isin(*JSON_SERVICES) & (msg != "")
    is_logfmt = service.isin(*LOGFMT_SERVICES) & (msg != "")
    plain = records.withColumn("_plain", F.when(is_logfmt, plain_json(msg)))
    keyed = plain.withColumn("_keys", F.json_object_keys("_plain"))
    parsed = keyed.withColumn(
        "_parsed",
        F.when(is_json, only_value(msg)).when(
            is_logfmt, logfmt_json(msg, F.col("_plain"), F.col("_keys"))
        ),
    )
    failed = F.col("_parsed").isNull()
    return parsed.withColumns({
        "data": F.coalesce("_parsed", "data"),
        "parse_error": F.when(is_json & failed, F.lit(NOT_JSON))
        .when(is_logfmt & failed, F.lit(NOT_LOGFMT))
        .otherwise(F.col("parse_error")),
    }).drop("_plain", "_keys", "_parsed")


def promote(records: DataFrame) -> DataFrame:
    """Fill null domain fields from ``data``. Values that are not text are taken as text."""
    return _promote(_read_data(records)).drop("_given")


def best_effort(records: DataFrame) -> DataFrame:
    """Search the message for fields that ``data`` did not give as text."""
    return _best_effort(_read_data(records)).drop("_given")


def _read_data(records: DataFrame) -> DataFrame:
    kinds = {name: "variant" if name in SEARCHED else "string" for name in PROMOTED}
    # Most data has none of the fields, which is cheap to see: a key is quoted text, or has an
    # escape in it.
    hints = [*(f'"{name}"' for name in PROMOTED), "\\u"]
    hinted = reduce(or_, [F.contains(F.col("data"), F.lit(hint)) for hint in hints])
    data = F.when(hinted, F.col("data"))
    return records.withColumn("_given", object_fields(data, kinds))


def _promote(records: DataFrame) -> DataFrame:
    return records.withColumns({
        name: F.coalesce(F.col(name), F.col(f"_given.{name}").cast("string")) for name in PROMOTED
    })


def _best_effort(records: DataFrame) -> DataFrame:
    def searched(name: str, marker: str) -> Column:
        settled = F.col(name).isNotNull() & is_text(F.col(f"_given.{name}"))
        return F.when(settled, F.col(name)).otherwise(
            F.coalesce(word_after(F.col("msg"), marker), F.col(name))
        )

    return records.withColumns({name: searched(name, marker) for name, marker in SEARCHED.items()})


def normalize_logs(landed: DataFrame) -> DataFrame:
    """Landed syslog records to lake records."""
    records = _read_data(sanitize(prepare(landed)))
    return _best_effort(_promote(records)).drop("_given")
