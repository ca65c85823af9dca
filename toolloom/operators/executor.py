"""The executor of calls on entity state: reads, acknowledgements and state changes as expressions.

State is a struct of a subscriber's columns. A call's effect is the state with some fields replaced; a
sequence of calls on one subscriber is a fold over the call array, so each sample sees its own calls in
order and no other sample's.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolloom.functions.json import args_map
from toolloom.operators.ranks import numbered

STATE = "struct<customer_id:string,status:string,plan_id:string,subscription_type:string,outstanding_balance:double,balance:double,billing_email:string,roaming_enabled:boolean,lost_sim_reported:boolean,esim_supported:boolean,esim_active:boolean,sim_type:string,data_used_gb:double,voice_minutes:bigint,eid:string,credit_limit:double,spending_limit:double,premium_sms_blocked:boolean,autopay_enabled:boolean,owner_id:string,tickets:int>"
#: Fixed value: the one-time code of the test double.
TEST_CODE = "123456"
#: Rows of a catalogue (areas, plans) that is held in one row beside the calls.
CATALOGUE_ROWS = 10_000


def _arg(args: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_element_at(args, F.lit(name)), "$", kind)


#: State changes by tool: field -> new value from (state, args).
WRITES: dict[str, dict[str, Callable[[Column, Column], Column]]] = {
    "change_plan": {"plan_id": lambda s, a: _arg(a, "new_plan")},
    "suspend_line": {"status": lambda s, a: F.lit("suspended")},
    "resume_line": {"status": lambda s, a: F.lit("active")},
    "cancel_subscription": {"status": lambda s, a: F.lit("cancelled")},
    "report_lost_sim": {"lost_sim_reported": lambda s, a: F.lit(True)},
    "update_billing_email": {"billing_email": lambda s, a: _arg(a, "email")},
    "enable_roaming": {"roaming_enabled": lambda s, a: F.lit(True)},
    "disable_roaming": {"roaming_enabled": lambda s, a: F.lit(False)},
    "pay_bill": {"outstanding_balance": lambda s, a: F.greatest(F.lit(0.0), s["outstanding_balance"] - F.coalesce(_arg(a, "amount", "double"), F.lit(0.0)))},
    "activate_esim": {"esim_active": lambda s, a: F.lit(True), "eid": lambda s, a: _arg(a, "eid")},
    "replace_sim": {"sim_type": lambda s, a: _arg(a, "sim_type")},
    "open_support_ticket": {"tickets": lambda s, a: F.coalesce(s["tickets"], F.lit(0)) + 1},
    "increase_credit_limit": {"credit_limit": lambda s, a: _arg(a, "new_limit", "double")},
    "set_spending_limit": {"spending_limit": lambda s, a: _arg(a, "limit", "double")},
    "block_premium_sms": {"premium_sms_blocked": lambda s, a: F.lit(True)},
    "unblock_premium_sms": {"premium_sms_blocked": lambda s, a: F.lit(False)},
    "register_autopay": {"autopay_enabled": lambda s, a: F.lit(True)},
    "remove_autopay": {"autopay_enabled": lambda s, a: F.lit(False)},
    "transfer_ownership": {"owner_id": lambda s, a: _arg(a, "new_owner_id")},
}

def _given(args: Column, name: str) -> Column:
    """An argument with its JSON type."""
    return F.try_element_at(args, F.lit(name))


def _paid(s: Column, a: Column) -> Column:
    return WRITES["pay_bill"]["outstanding_balance"](s, a)


def _always(value) -> Callable[[Column, Column], Column]:
    return lambda s, a: F.lit(value)


def _held(field: str) -> Callable[[Column, Column], Column]:
    return lambda s, a: s[field]


def _echo(name: str) -> Callable[[Column, Column], Column]:
    return lambda s, a: _given(a, name)


#: What a call answers, field by field from (state, args); the state is the one before the call. Names and texts.
OUTPUTS: dict[str, dict[str, Callable[[Column, Column], Column]]] = {
    "get_balance": {"balance": _held("balance"), "outstanding_balance": _held("outstanding_balance")},
    "get_current_plan": {"plan_id": _held("plan_id"), "status": _held("status")},
    "get_usage": {"data_used_gb": lambda s, a: F.coalesce(s["data_used_gb"], F.lit(0.0)), "voice_minutes": lambda s, a: F.coalesce(s["voice_minutes"], F.lit(0))},
    "get_customer_profile": {k: _held(k) for k in ("customer_id", "status", "plan_id", "billing_email")},
    "add_data_package": {"package_code": _echo("package_code"), "status": _always("queued")},
    "change_plan": {"plan_id": _echo("new_plan"), "status": _always("changed")},
    "suspend_line": {"status": _always("suspended"), "reason": _echo("reason")},
    "resume_line": {"status": _always("active")},
    "cancel_subscription": {"status": _always("cancelled")},
    "report_lost_sim": {"lost_sim_reported": _always(True)},
    "update_billing_email": {"billing_email": _echo("email")},
    "enable_roaming": {"roaming_enabled": _always(True), "country": _echo("country")},
    "disable_roaming": {"roaming_enabled": _always(False)},
    "pay_bill": {"outstanding_balance": _paid, "paid_amount": _echo("amount")},
    "activate_esim": {"esim_active": _always(True), "eid": _echo("eid")},
    "replace_sim": {"sim_type": _echo("sim_type"), "status": _always("replacement_queued")},
    "open_support_ticket": {
        "ticket_id": lambda s, a: F.lit(None).cast("string"),  # numbered by ``output``
        "customer_id": _echo("customer_id"), "category": _echo("category"),
        "priority": lambda s, a: F.coalesce(_arg(a, "priority"), F.lit("normal")),
    },
    "close_support_ticket": {"ticket_id": _echo("ticket_id"), "status": _always("closed")},
    "send_otp": {"otp_sent": _always(True), "channel": _echo("channel")},
    "verify_otp": {"verified": lambda s, a: F.coalesce(_arg(a, "otp") == TEST_CODE, F.lit(False))},
    "apply_late_fee_waiver": {"waiver_applied": _always(True), "amount": _echo("amount")},
    "increase_credit_limit": {"credit_limit": _echo("new_limit")},
    "set_spending_limit": {"spending_limit": _echo("limit")},
    "block_premium_sms": {"premium_sms_blocked": _always(True)},
    "unblock_premium_sms": {"premium_sms_blocked": _always(False)},
    "register_autopay": {"autopay_enabled": _always(True)},
    "remove_autopay": {"autopay_enabled": _always(False)},
    "transfer_ownership": {"owner_id": _echo("new_owner_id")},
}
#: The tool whose answers are numbered.
TICKET = "open_support_ticket"
#: Tools that answer from other tables: network status by area, all plans.
LOOKUPS = ("check_network_status", "list_available_plans")
SUPPORTED = sorted({*OUTPUTS, *LOOKUPS})


def execution_error(tool: Column, state: Column, customer: Column | None = None) -> Column:
    """Why a call can't run: no subscriber, then no such tool; null if it can."""
    named = F.lit("None") if customer is None else F.coalesce(customer, F.lit("None"))
    return F.when(state.isNull(), F.concat(F.lit("Subscriber not found: "), named)).when(~F.coalesce(tool.isin(SUPPORTED), F.lit(False)), F.concat(F.lit("Unsupported tool: "), F.coalesce(tool, F.lit("None"))))


def apply_call(state: Column, tool: Column, args: Column) -> Column:
    """The state after a call; calls that can't run or only read leave it."""
    fields: dict[str, Column] = {}
    for name, changes in WRITES.items():
        for field, value in changes.items():
            old = fields.get(field, state[field])
            fields[field] = F.when(tool == name, value(state, args)).otherwise(old)
    out = state
    for field, value in fields.items():
        out = out.withField(field, value)
    return out


def output(state: Column, tool: Column, args: Column, networks: Column | None = None, plans: Column | None = None, tickets: Column | None = None) -> Column:
    """A call's answer as JSON, null fields shown; null where ``execution_error`` is not.

    ``tickets`` is how many the sample has opened before, of whatever subscriber; none if it is left out.

    ``networks`` is a map of areas' rows as JSON texts, ``plans`` an array of all plans' rows; an area that the map
    lacks is ``unknown``.
    """
    keep = {"ignoreNullFields": "false"}
    out = F.when(execution_error(tool, state).isNotNull(), None)
    number = F.format_string("T%04d", F.lit(1) if tickets is None else tickets + 1)
    for name, fields in OUTPUTS.items():
        if "ticket_id" in fields and name == TICKET:
            fields = fields | {"ticket_id": lambda s, a: number}
        out = out.when(tool == name, F.to_json(F.struct(*(made(state, args).alias(f) for f, made in fields.items())), keep))
    area = _arg(args, "area_code")
    unknown = F.to_json(F.struct(_given(args, "area_code").alias("area_code"), F.lit("unknown").alias("status")), keep)
    known = F.lit(None).cast("string") if networks is None else F.try_element_at(networks, F.coalesce(area, F.lit("")))
    listed = F.lit("") if plans is None else F.array_join(plans, ",")
    return out.when(tool == "check_network_status", F.coalesce(known, unknown)).when(tool == "list_available_plans", F.concat(F.lit('{"plans":['), listed, F.lit("]}")))


def lookups(networks: DataFrame, plans: DataFrame) -> DataFrame:
    """One row ``networks, plans`` for ``output``, of ``networks(area_code, ...)`` and ``plans(plan_id, ...)``; of equal keys one stays.

    Both are catalogues that fit a row: beyond ``CATALOGUE_ROWS`` rows a ValueError says so.
    """
    for df in (networks, plans):
        if df.limit(CATALOGUE_ROWS + 1).count() > CATALOGUE_ROWS:
            raise ValueError(f"a catalogue of more than {CATALOGUE_ROWS} rows does not fit a row")
    keep = {"ignoreNullFields": "false"}
    areas = networks.where(F.col("area_code").isNotNull()).groupBy("area_code").agg(F.max(F.to_json(F.struct(*networks.columns), keep)).alias("text"))
    rows = plans.groupBy("plan_id").agg(F.max(F.to_json(F.struct(*plans.columns), keep)).alias("text"))
    areas = areas.agg(F.map_from_entries(F.collect_list(F.struct("area_code", "text"))).alias("networks"))
    return areas.crossJoin(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("plan_id", "text"))), lambda r: r["text"]).alias("plans")))  # one row each


#: What stations show by the kind of a query: field, and the values that a hash picks from (fixed values).
ATTRIBUTES = {
    "tilt": ("tilt_deg", [x / 10 for x in range(20, 81)]),
    "antenna_height": ("antenna_height_m", [18, 24, 30, 36, 42]),
    "station_distance": ("distance_km", [x / 10 for x in range(5, 51)]),
    "": ("status", ["active", "active", "maintenance"]),
}


def observation(calls: DataFrame, stations: DataFrame, seed: int = 0, k: int = 3) -> DataFrame:
    """``calls(id, location, query_type, ...)`` with ``observation``, the stations that a listing call shows, as JSON.

    ``stations(station_code, location_code, name)``: the first ``k`` codes of the location, or of the whole catalogue
    where it has none there. A station's attribute follows from a hash of seed, call and station.
    """
    listed = F.slice(F.array_sort(F.collect_list(F.struct("station_code", "name"))), 1, k)
    order = Window.partitionBy("location_code").orderBy("station_code")
    first = stations.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)  # k rows a location
    local = first.groupBy(F.col("location_code").alias("_location")).agg(listed.alias("_local"))
    spare = stations.orderBy("station_code").limit(k).agg(listed.alias("_spare"))
    joined = calls.join(local, F.col("location") == F.col("_location"), "left").crossJoin(F.broadcast(spare))  # one row of k stations
    kind = F.coalesce("query_type", F.lit(""))

    def shown(s: Column) -> Column:
        at = F.xxhash64(F.lit(seed), "id", s["station_code"])
        texts = [F.when(kind == name if name else ~kind.isin([n for n in ATTRIBUTES if n]), F.concat(F.lit(f',"{field}":'), F.element_at(F.array(*(F.lit(json.dumps(v)) for v in values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int")))) for name, (field, values) in ATTRIBUTES.items()]
        plain = F.to_json(F.struct(s["station_code"].alias("station_code"), s["name"].alias("name")), {"ignoreNullFields": "false"})
        return F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.coalesce(*texts), F.lit("}"))

    pool = F.coalesce("_local", "_spare")
    place = F.to_json(F.struct(F.col("location")), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"count":'), F.size(pool).cast("string"), F.lit(","), F.substring(place, F.lit(2), F.length(place) - 2), F.lit(',"stations":['), F.array_join(F.transform(pool, shown), ","), F.lit("]}"))
    return joined.select(*calls.columns, text.alias("observation"))


def fold(state: Column, calls: Column, args_of: Callable[[Column], Column]) -> Column:
    """The state after an array of calls ``struct<tool_name, arguments>`` in order."""
    return F.aggregate(calls, state, lambda s, c: apply_call(s, c["tool_name"], args_of(c["arguments"])))


#: Rows of a stretch of calls whose running sums are taken in one go, as a power of two.
STRETCH = 12


def fold_table(states: DataFrame, calls: DataFrame) -> DataFrame:
    """``customer_id, state`` after all of ``calls(customer_id, pos, tool_name, arguments)`` in order of ``pos``, for any number of calls on one customer.

    ``states(customer_id, state)``; customers without calls keep theirs, calls on others do nothing. As in ``fold``, calls are not checked. No
    customer's calls are gathered: a field that calls set takes the value of the last call that sets it (a maximum by position), tickets are a
    count, and payments that never leave less than 0 are the greatest of the first balance and of all running sums, less the whole sum;
    running sums are taken in stretches of 4,096 calls, and over the stretches' own sums.
    """
    c = F.col
    known = calls.where(c("tool_name").isin(list(WRITES)) & c("customer_id").isNotNull()).select("customer_id", "pos", "tool_name", args_map(c("arguments")).alias("a"))
    state = states.schema["state"].dataType
    empty = F.lit(None).cast(state)
    set_by: dict[str, Column] = {}
    for tool, changes in WRITES.items():
        for field, value in changes.items():
            if field not in ("outstanding_balance", "tickets"):
                held = F.struct(value(empty, c("a")).cast(state[field].dataType).alias("v"))
                set_by[field] = F.when(c("tool_name") == tool, held) if field not in set_by else set_by[field].when(c("tool_name") == tool, held)
    lasts = [F.max_by(v, F.when(v.isNotNull(), c("pos"))).alias(f"_{field}") for field, v in set_by.items()]
    plain = known.groupBy("customer_id").agg(*lasts, F.count_if(c("tool_name") == TICKET).alias("_tickets"))

    paid = known.where("tool_name = 'pay_bill'").select("customer_id", "pos", F.coalesce(_arg(c("a"), "amount", "double"), F.lit(0.0)).alias("amount"))
    paid = numbered(paid, ["customer_id"], ["pos"], "_n").withColumn("_stretch", F.shiftright("_n", STRETCH))
    running = Window.partitionBy("customer_id", "_stretch").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    sums = paid.withColumn("_s", F.sum("amount").over(running)).groupBy("customer_id", "_stretch").agg(F.sum("amount").alias("_sum"), F.max("_s").alias("_top"))
    earlier = Window.partitionBy("customer_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    sums = sums.withColumn("_top", c("_top") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    sums = sums.groupBy(c("customer_id").alias("_paying")).agg(F.sum("_sum").alias("_paid"), F.max("_top").alias("_top"))
    out = states.join(plain.withColumnRenamed("customer_id", "_calling"), c("customer_id") == c("_calling"), "left").join(sums, c("customer_id") == c("_paying"), "left")
    after = c("state")
    for field in set_by:
        after = after.withField(field, F.when(c(f"_{field}").isNotNull(), c(f"_{field}.v")).otherwise(c(f"state.{field}")))
    # without a balance the first payment leaves 0, as the greatest of nothing and 0 does
    owed = F.greatest(c("state.outstanding_balance"), c("_top")) - c("_paid")
    after = after.withField("outstanding_balance", F.when(c("_paid").isNotNull(), owed).otherwise(c("state.outstanding_balance")))
    after = after.withField("tickets", F.when(F.coalesce(c("_tickets"), F.lit(0)) > 0, F.coalesce(c("state.tickets"), F.lit(0)) + c("_tickets").cast("int")).otherwise(c("state.tickets")))
    return out.select("customer_id", F.when(c("state").isNotNull(), after).alias("state"))
