"""Scalar decision, sizing, cost and risk rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def finite(x: Column, otherwise: float) -> Column:
    """``x`` where it is a finite number."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, x).otherwise(F.lit(float(otherwise)))


def kelly(win_rate: Column, payoff: Column) -> Column:
    """Kelly share of a win rate and a payoff ratio, in [0, 1]; odd inputs count as 0 wins and payoff 1."""
    b = finite(payoff, 1.0)
    b = F.when(b <= 0, F.lit(1.0)).otherwise(b)
    p = finite(win_rate, 0.0)
    return clip(p - (1 - p) / b, 0, 1)


def market_impact(qty: Column, price: Column, volatility: Column, volume: Column, temporary=0.1, permanent=0.05, most_bps=50.0) -> Column:
    """Square-root impact: struct(temporary, permanent, bps, cost, acceptable); all 0 for no quantity or an invalid price."""
    share = F.abs(qty) / F.greatest(volume, F.lit(1.0))
    vol = F.greatest(volatility, F.lit(1e-8))
    none = (qty == 0) | (finite(price, 0.0) <= 0)
    temp = F.when(none, 0.0).otherwise(temporary * vol * F.sqrt(share))
    perm = F.when(none, 0.0).otherwise(permanent * vol * share)
    bps = (temp + perm) * 10_000
    return F.struct(temp.alias("temporary"), perm.alias("permanent"), bps.alias("bps"), ((temp + perm) * price * F.abs(qty)).alias("cost"), (bps <= most_bps).alias("acceptable"))


def regime_multiplier(volatility: Column, high=0.02, crisis=0.05, multipliers=(1.0, 1.5, 2.5, 5.0)) -> Column:
    """Slippage multiplier of a volatility level."""
    low, normal, high_mult, crisis_mult = multipliers
    return F.when(volatility >= crisis, crisis_mult).when(volatility >= high, high_mult).when(volatility >= high / 2, normal).otherwise(low)


def half_spread(price: Column, bid: Column, ask: Column, base_bps: float = 1.0) -> Column:
    return F.when(ask > bid, (ask - bid) / 2).otherwise(price * base_bps / 10_000)


def round_trip_cost(price: Column, qty: Column, bid: Column, ask: Column, impact: float = 0.0001) -> Column:
    """Expected cost of entry and exit as a share of the price, without noise."""
    cost = 2 * (half_spread(price, bid, ask) + impact * F.sqrt(F.abs(qty))) / price
    return F.when((price <= 0) | (qty <= 0), 0.0).otherwise(cost)


def confidence(regime: Column, significant: Column, strength: Column, divergence: Column, velocity: Column, acceleration: Column, entropy_acceleration: Column, liquid: Column, spread: Column, imbalance: Column) -> Column:
    """Composite confidence in [0, 1] from regime, transition, information, dynamics and liquidity."""
    rc = clip(regime, 0, 1)
    ts = F.when(significant, clip(strength, 0, 1)).otherwise(0.0)
    info = F.coalesce(F.tanh(2 * F.greatest(F.lit(0.0), divergence)), F.lit(0.0))
    aligned = F.when(F.signum(velocity) == F.signum(acceleration), 0.8).otherwise(0.2)
    aligned = F.when(F.abs(entropy_acceleration) < 0.5, F.least(F.lit(1.0), aligned + 0.2)).otherwise(aligned)
    dynamics = F.when((velocity != 0) & (acceleration != 0), aligned).otherwise(0.0)
    book = 0.6 * clip(1 - spread * 100, 0, 1) + 0.4 * clip(1 - F.abs(imbalance), 0, 1)
    liquidity = F.when(liquid.isNull(), 0.5).when(liquid & (spread > 0), book).when(~liquid, 0.0).otherwise(0.5)
    return clip(0.25 * rc + 0.30 * ts + 0.20 * info + 0.15 * dynamics + 0.10 * liquidity, 0, 1)


def conviction(strength: Column, dwell: Column, fall: Column, tail: Column, dwell_norm=50.0, most_fall=0.02) -> Column:
    """Scale of a position in [0.25, 1.5] from transition strength, dwell time, drawdown and tail slope."""
    s = clip(finite(strength, 0.0), 0, 1)
    d = finite(dwell, -1.0)
    persistence = F.when(d > 0, F.least(F.lit(1.0), F.log1p(d / dwell_norm) / 3)).otherwise(0.5)
    damped = F.when(fall > most_fall * 0.15, F.greatest(F.lit(0.3), 1 - F.least(F.lit(1.0), fall / most_fall) * 0.7)).otherwise(1.0)
    t = finite(tail, 0.0)
    thin = F.when(t > 0, clip(2 / F.greatest(t, F.lit(0.5)), 0.5, 1)).otherwise(1.0)
    return clip((s + persistence) * damped * thin, 0.25, 1.5)


def position_size(equity: Column, price: Column, stop: Column, win_rate: Column, payoff: Column, scale: Column, tail: Column, var_95: Column, depth_cap: Column, kelly_scale=0.5, most_fall=0.02, penalty_floor=0.2) -> Column:
    """Quantity risked: half-Kelly of the equity over the stop distance times conviction, capped by drawdown, leverage and book depth.

    The stop covers 1.5 times the value at risk at least; a Kelly share below 1 % risks half a percent. The tail
    penalty may be below 1 and then raises the drawdown cap.
    """
    stop = F.when((var_95 < 0) & (price > 0), F.greatest(stop, F.abs(var_95) * 1.5)).otherwise(stop)
    raw = kelly(win_rate, payoff)
    risk = F.when(raw < 0.01, F.greatest(raw * kelly_scale, F.lit(0.005))).otherwise(raw * kelly_scale)
    size = equity * risk / (price * stop) * scale
    penalty = F.when(finite(tail, 0.0) > 0, clip(tail / 2, penalty_floor, 2)).otherwise(1.0)
    size = F.least(size, equity * most_fall / penalty / (price * stop), equity / price)
    size = F.greatest(size, F.lit(0.0))
    return F.when((equity > 0) & (price > 0) & (stop > 1e-9), F.when(depth_cap > 0, F.least(size, depth_cap)).otherwise(size)).otherwise(0.0)


def exit_parameters(volatility: Column, skew: Column, kurt: Column, entropy: Column, fall: Column, strength: Column, win_rate: Column) -> Column:
    """struct(stop, take_profit, trail, hold, rr) of a neutral regime, from the base volatility and the state's shape."""
    heavy = F.greatest(F.lit(0.0), finite(kurt, 3.0) - 3)
    damp = F.when(fall > 0.01, F.greatest(F.lit(0.5), 1 - fall * 5)).otherwise(1.0)
    stop = F.greatest(F.lit(0.001), volatility * 0.6 * F.least(F.lit(1.2), 1 + heavy * 0.05) * 0.8 * damp)
    take = F.greatest(F.lit(0.0015), volatility * 1.2 * F.greatest(F.lit(0.8), 1 + F.abs(finite(skew, 0.0)) * 0.2) * (1 + strength * 0.5))
    trail = F.greatest(F.lit(0.001), volatility * 0.5 * (1 + heavy * 0.05) * damp)
    hold = F.least(F.greatest(F.lit(5), 80 + F.floor(1 / (1 + F.abs(finite(entropy, 1.0))) * 2.0 * 0.5).cast("int")), F.lit(160))
    base = F.when(win_rate >= 0.6, 1.0).when(win_rate >= 0.45, 1.2).otherwise(1.5)
    rr = base * F.greatest(F.lit(0.8), 1 - strength * 0.2) * F.when(fall > 0.005, 1 + fall * 5).otherwise(1.0)
    rr = clip(rr, 0.5, 3.0)
    return F.struct(stop.alias("stop"), F.greatest(take, stop * rr).alias("take_profit"), trail.alias("trail"), hold.alias("hold"), rr.alias("rr"))


def entry_action(divergence: Column, projection: Column, velocity: Column, acceleration: Column, entropy_acceleration: Column, strength: Column, autocorrelation: Column, imbalance: Column, liquid: Column, trending=0.1, kl_min=0.02, projection_min=0.01, entropy_limit=2.0, fallback=0.30, flow=0.3) -> Column:
    """BUY, SELL or null: with a decelerating trend where returns persist, against it where they do not, flow-checked if merely strong."""
    gate = (divergence >= kl_min) & (projection >= projection_min) & F.coalesce(liquid, F.lit(True))
    persists = autocorrelation > trending
    slowing = F.abs(acceleration) < F.abs(velocity) * 0.5
    calm = F.abs(entropy_acceleration) <= entropy_limit
    up, down = (velocity > 0) & ((acceleration < 0) | slowing) & calm, (velocity < 0) & ((acceleration > 0) | slowing) & calm
    strong = strength >= fallback
    buys, sells = strong & (imbalance > -flow), strong & (imbalance < flow)
    rising = F.when(persists, F.when(buys, "BUY")).otherwise(F.when(sells, "SELL"))
    falling = F.when(persists, F.when(sells, "SELL")).otherwise(F.when(buys, "BUY"))
    action = (
        F.when(up, F.when(persists, "BUY").otherwise("SELL"))
        .when(down, F.when(persists, "SELL").otherwise("BUY"))
        .when(velocity > 0, rising)
        .when(velocity < 0, falling)
    )
    return F.when(gate, action)


def compliance_reason(price: Column, last_price: Column, qty: Column, action: Column, held: Column, last_action: Column, since_s: Column, quote_age_s: Column, collar=0.05, order_cap=500_000.0, position_cap=2_000_000.0, wash_s=10.0, stale_s=5.0) -> Column:
    """Name of the first rule that an order breaks, or OK."""
    notional = qty * price
    projected = F.when(action == "BUY", held + notional).otherwise(held - notional)
    return (
        F.when((last_price > 0) & (price > 0) & (F.abs(price - last_price) / last_price > collar), "PRICE_COLLAR")
        .when(notional > order_cap, "ORDER_SIZE")
        .when(F.abs(projected) > position_cap, "POSITION_LIMIT")
        .when((last_action != action) & (since_s < wash_s), "WASH_TRADE")
        .when(quote_age_s > stale_s, "STALE_QUOTE")
        .otherwise("OK")
    )


def risk_adjustments(sigma: Column, kurt: Column, tail: Column, entropy: Column, trend: Column, reverting: Column, tail_limit=3.0, kurt_limit=5.0, entropy_limit=2.0, sigma_limit=0.02, trend_scale=0.5) -> Column:
    """struct(stop, size, exposure) multipliers of a state; neutral for non-finite states."""
    valid = finite(sigma, float("inf")) < float("inf")
    stop = F.when(tail > tail_limit, F.when(reverting, 0.95).otherwise(0.8)).otherwise(1.0) * F.when((kurt > kurt_limit) & ~reverting, 0.9).otherwise(1.0)
    rising = F.when(reverting, 1 - F.least(trend * trend_scale * 0.3, F.lit(0.2))).otherwise(1 - F.least(trend * trend_scale, F.lit(0.5)))
    size = F.when(trend > 0, rising).otherwise(1.0) * F.when(entropy > entropy_limit, F.when(reverting, 0.85).otherwise(0.7)).otherwise(1.0)
    exposure = F.when(sigma > sigma_limit, F.when(reverting, 0.75).otherwise(0.5)).otherwise(1.0)
    return F.when(valid, F.struct(clip(stop, 0.5, 1.5).alias("stop"), clip(size, 0.1, 1.0).alias("size"), exposure.alias("exposure"))).otherwise(
        F.struct(F.lit(1.0).alias("stop"), F.lit(1.0).alias("size"), F.lit(1.0).alias("exposure"))
    )


def levels(mid: Column, half: Column, depth: Column, side: int, count: int = 5) -> Column:
    """A synthetic ladder of (price, size) levels away from the mid: side 1 for asks, -1 for bids, best first."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct((mid + side * half * (i + 1)).alias("price"), (depth * (1 + i * 0.5)).alias("size")))


def book_pressure(bids: Column, asks: Column) -> Column:
    """Imbalance of sizes weighted by 1 / (1 + level), in [-1, 1]; 0 for an empty book."""

    def weighted(side):
        return F.aggregate(F.transform(side, lambda level, i: level["size"] / (1 + i)), F.lit(0.0), lambda s, x: s + x)

    b, a = weighted(bids), weighted(asks)
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def top_depth(side: Column, count: int = 3) -> Column:
    """Total size of the best levels."""
    return F.aggregate(F.slice(side, 1, count), F.lit(0.0), lambda s, level: s + level["size"])


def walk_book(side: Column, qty: Column) -> Column:
    """struct(filled, average) of a market order that eats levels until it is filled or the book ends."""
    start = F.struct(qty.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def eat(state, level):
        take = F.least(state["left"], level["size"])
        return F.struct((state["left"] - take).alias("left"), (state["cost"] + take * level["price"]).alias("cost"))

    def finish(state):
        filled = qty - state["left"]
        return F.struct(filled.alias("filled"), F.when(filled > 0, state["cost"] / filled).alias("average"))

    return F.aggregate(side, start, eat, finish)
