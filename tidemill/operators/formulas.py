"""The formulas of the paper "101 Formulaic Alphas" (Kakushadze, 2015), as expressions in the paper's own operators.

`formulas(p)` works on any algebra `p` that has the paper's inputs and operators: the panel's nodes (`factors.PanelAlgebra`), or frames in
a test. `where` is the paper's `? :`, `either` its `||`, `equal` its `==`; `smaller` and `larger` are min and max of two
values. Numbers of days may be fractions; they are cut to whole days. All industry classes are one: the whole cross-section.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


def formulas(p: Any) -> dict[int, Callable[[], Any]]:
    """Every formula by its number, built when it is called."""
    open_, high, low, close, volume, vwap, returns, cap, adv = p.open, p.high, p.low, p.close, p.volume, p.vwap, p.returns, p.cap, p.adv
    rank, delay, correlation, covariance, scale, delta = p.rank, p.delay, p.correlation, p.covariance, p.scale, p.delta
    signedpower, decay_linear, indneutralize = p.signedpower, p.decay_linear, p.indneutralize
    ts_min, ts_max, ts_argmax, ts_argmin, ts_rank = p.ts_min, p.ts_max, p.ts_argmax, p.ts_argmin, p.ts_rank
    total, product, stddev, log, sign, absolute = p.sum, p.product, p.stddev, p.log, p.sign, p.abs
    where, either, equal, smaller, larger = p.where, p.either, p.equal, p.smaller, p.larger

    def bend() -> Any:
        """How the slope of the last ten days differs from that of the ten before."""
        return ((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10)

    def place() -> Any:
        """Where the close lies between low and high, from -1 to 1 times the volume."""
        return (((close - low) - (high - close)) / (high - low)) * volume

    def mixed(x: Any, y: Any, share: float) -> Any:
        return (x * share) + (y * (1 - share))

    # The formulas and their constants.
    return {
        1: lambda: rank(ts_argmax(signedpower(where(returns < 0, stddev(returns, 20), close), 2.0), 5)) - 0.5,
        2: lambda: -1 * correlation(rank(delta(log(volume), 2)), rank((close - open_) / open_), 6),
        3: lambda: -1 * correlation(rank(open_), rank(volume), 10),
        4: lambda: -1 * ts_rank(rank(low), 9),
        5: lambda: rank(open_ - (total(vwap, 10) / 10)) * (-1 * absolute(rank(close - vwap))),
        6: lambda: -1 * correlation(open_, volume, 10),
        7: lambda: where(adv(20) < volume, (-1 * ts_rank(absolute(delta(close, 7)), 60)) * sign(delta(close, 7)), -1),
        8: lambda: -1 * rank((total(open_, 5) * total(returns, 5)) - delay(total(open_, 5) * total(returns, 5), 10)),
        9: lambda: where(
            0 < ts_min(delta(close, 1), 5), delta(close, 1), where(ts_max(delta(close, 1), 5) < 0, delta(close, 1), -1 * delta(close, 1))
        ),
        10: lambda: rank(
            where(0 < ts_min(delta(close, 1), 4), delta(close, 1), where(ts_max(delta(close, 1), 4) < 0, delta(close, 1), -1 * delta(close, 1)))
        ),
        11: lambda: (rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3)),
        12: lambda: sign(delta(volume, 1)) * (-1 * delta(close, 1)),
        13: lambda: -1 * rank(covariance(rank(close), rank(volume), 5)),
        14: lambda: (-1 * rank(delta(returns, 3))) * correlation(open_, volume, 10),
        15: lambda: -1 * total(rank(correlation(rank(high), rank(volume), 3)), 3),
        16: lambda: -1 * rank(covariance(rank(high), rank(volume), 5)),
        17: lambda: ((-1 * rank(ts_rank(close, 10))) * rank(delta(delta(close, 1), 1))) * rank(ts_rank(volume / adv(20), 5)),
        18: lambda: -1 * rank((stddev(absolute(close - open_), 5) + (close - open_)) + correlation(close, open_, 10)),
        19: lambda: (-1 * sign((close - delay(close, 7)) + delta(close, 7))) * (1 + rank(1 + total(returns, 250))),
        20: lambda: ((-1 * rank(open_ - delay(high, 1))) * rank(open_ - delay(close, 1))) * rank(open_ - delay(low, 1)),
        21: lambda: where(
            ((total(close, 8) / 8) + stddev(close, 8)) < (total(close, 2) / 2), -1,
            where((total(close, 2) / 2) < ((total(close, 8) / 8) - stddev(close, 8)), 1, where(either(1 < (volume / adv(20)), equal(volume / adv(20), 1)), 1, -1)),
        ),
        22: lambda: -1 * (delta(correlation(high, volume, 5), 5) * rank(stddev(close, 20))),
        23: lambda: where((total(high, 20) / 20) < high, -1 * delta(high, 2), 0),
        24: lambda: where(
            either((delta(total(close, 100) / 100, 100) / delay(close, 100)) < 0.05, equal(delta(total(close, 100) / 100, 100) / delay(close, 100), 0.05)),
            -1 * (close - ts_min(close, 100)), -1 * delta(close, 3),
        ),
        25: lambda: rank((((-1 * returns) * adv(20)) * vwap) * (high - close)),
        26: lambda: -1 * ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3),
        27: lambda: where(0.5 < rank(total(correlation(rank(volume), rank(vwap), 6), 2) / 2.0), -1, 1),
        28: lambda: scale((correlation(adv(20), low, 5) + ((high + low) / 2)) - close),
        29: lambda: ts_min(product(rank(rank(scale(log(total(ts_min(rank(rank(-1 * rank(delta(close - 1, 5)))), 2), 1))))), 1), 5)
        + ts_rank(delay(-1 * returns, 6), 5),
        30: lambda: (
            (1.0 - rank((sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2))) + sign(delay(close, 2) - delay(close, 3)))) * total(volume, 5)
        ) / total(volume, 20),
        31: lambda: (rank(rank(rank(decay_linear(-1 * rank(rank(delta(close, 10))), 10)))) + rank(-1 * delta(close, 3))) + sign(scale(correlation(adv(20), low, 12))),
        32: lambda: scale((total(close, 7) / 7) - close) + (20 * scale(correlation(vwap, delay(close, 5), 230))),
        33: lambda: rank(-1 * (1 - (open_ / close))),
        34: lambda: rank((1 - rank(stddev(returns, 2) / stddev(returns, 5))) + (1 - rank(delta(close, 1)))),
        35: lambda: (ts_rank(volume, 32) * (1 - ts_rank((close + high) - low, 16))) * (1 - ts_rank(returns, 32)),
        36: lambda: (
            (((2.21 * rank(correlation(close - open_, delay(volume, 1), 15))) + (0.7 * rank(open_ - close))) + (0.73 * rank(ts_rank(delay(-1 * returns, 6), 5))))
            + rank(absolute(correlation(vwap, adv(20), 6)))
        ) + (0.6 * rank(((total(close, 200) / 200) - open_) * (close - open_))),
        37: lambda: rank(correlation(delay(open_ - close, 1), close, 200)) + rank(open_ - close),
        38: lambda: (-1 * rank(ts_rank(close, 10))) * rank(close / open_),
        39: lambda: (-1 * rank(delta(close, 7) * (1 - rank(decay_linear(volume / adv(20), 9))))) * (1 + rank(total(returns, 250))),
        40: lambda: (-1 * rank(stddev(high, 10))) * correlation(high, volume, 10),
        41: lambda: ((high * low) ** 0.5) - vwap,
        42: lambda: rank(vwap - close) / rank(vwap + close),
        43: lambda: ts_rank(volume / adv(20), 20) * ts_rank(-1 * delta(close, 7), 8),
        44: lambda: -1 * correlation(high, rank(volume), 5),
        45: lambda: -1 * ((rank(total(delay(close, 5), 20) / 20) * correlation(close, volume, 2)) * rank(correlation(total(close, 5), total(close, 20), 2))),
        46: lambda: where(0.25 < bend(), -1, where(bend() < 0, 1, -1 * (close - delay(close, 1)))),
        47: lambda: (((rank(1 / close) * volume) / adv(20)) * ((high * rank(high - close)) / (total(high, 5) / 5))) - rank(vwap - delay(vwap, 5)),
        48: lambda: indneutralize((correlation(delta(close, 1), delta(delay(close, 1), 1), 250) * delta(close, 1)) / close)
        / total((delta(close, 1) / delay(close, 1)) ** 2, 250),
        49: lambda: where(bend() < -0.1, 1, -1 * (close - delay(close, 1))),
        50: lambda: -1 * ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5),
        51: lambda: where(bend() < -0.05, 1, -1 * (close - delay(close, 1))),
        52: lambda: (((-1 * ts_min(low, 5)) + delay(ts_min(low, 5), 5)) * rank((total(returns, 240) - total(returns, 20)) / 220)) * ts_rank(volume, 5),
        53: lambda: -1 * delta(((close - low) - (high - close)) / (close - low), 9),
        54: lambda: (-1 * ((low - close) * (open_**5))) / ((low - high) * (close**5)),
        55: lambda: -1 * correlation(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6),
        56: lambda: 0 - (1 * (rank(total(returns, 10) / total(total(returns, 2), 3)) * rank(returns * cap))),
        57: lambda: 0 - (1 * ((close - vwap) / decay_linear(rank(ts_argmax(close, 30)), 2))),
        58: lambda: -1 * ts_rank(decay_linear(correlation(indneutralize(vwap), volume, 3.92795), 7.89291), 5.50322),
        59: lambda: -1 * ts_rank(decay_linear(correlation(indneutralize(mixed(vwap, vwap, 0.728317)), volume, 4.25197), 16.2289), 8.19648),
        60: lambda: 0 - (1 * ((2 * scale(rank(place()))) - scale(rank(ts_argmax(close, 10))))),
        61: lambda: rank(vwap - ts_min(vwap, 16.1219)) < rank(correlation(vwap, adv(180), 17.9282)),
        62: lambda: (rank(correlation(vwap, total(adv(20), 22.4101), 9.91009)) < rank((rank(open_) + rank(open_)) < (rank((high + low) / 2) + rank(high)))) * -1,
        63: lambda: (
            rank(decay_linear(delta(indneutralize(close), 2.25164), 8.22237))
            - rank(decay_linear(correlation(mixed(vwap, open_, 0.318108), total(adv(180), 37.2467), 13.557), 12.2883))
        ) * -1,
        64: lambda: (
            rank(correlation(total(mixed(open_, low, 0.178404), 12.7054), total(adv(120), 12.7054), 16.6208))
            < rank(delta(mixed((high + low) / 2, vwap, 0.178404), 3.69741))
        ) * -1,
        65: lambda: (rank(correlation(mixed(open_, vwap, 0.00817205), total(adv(60), 8.6911), 6.40374)) < rank(open_ - ts_min(open_, 13.635))) * -1,
        66: lambda: (
            rank(decay_linear(delta(vwap, 3.51013), 7.23052))
            + ts_rank(decay_linear((mixed(low, low, 0.96633) - vwap) / (open_ - ((high + low) / 2)), 11.4157), 6.72611)
        ) * -1,
        67: lambda: (rank(high - ts_min(high, 2.14593)) ** rank(correlation(indneutralize(vwap), indneutralize(adv(20)), 6.02936))) * -1,
        68: lambda: (ts_rank(correlation(rank(high), rank(adv(15)), 8.91644), 13.9333) < rank(delta(mixed(close, low, 0.518371), 1.06157))) * -1,
        69: lambda: (
            rank(ts_max(delta(indneutralize(vwap), 2.72412), 4.79344)) ** ts_rank(correlation(mixed(close, vwap, 0.490655), adv(20), 4.92416), 9.0615)
        ) * -1,
        70: lambda: (rank(delta(vwap, 1.29456)) ** ts_rank(correlation(indneutralize(close), adv(50), 17.8256), 17.9171)) * -1,
        71: lambda: larger(
            ts_rank(decay_linear(correlation(ts_rank(close, 3.43976), ts_rank(adv(180), 12.0647), 18.0175), 4.20501), 15.6948),
            ts_rank(decay_linear(rank((low + open_) - (vwap + vwap)) ** 2, 16.4662), 4.4388),
        ),
        72: lambda: rank(decay_linear(correlation((high + low) / 2, adv(40), 8.93345), 10.1519))
        / rank(decay_linear(correlation(ts_rank(vwap, 3.72469), ts_rank(volume, 18.5188), 6.86671), 2.95011)),
        73: lambda: larger(
            rank(decay_linear(delta(vwap, 4.72775), 2.91864)),
            ts_rank(decay_linear((delta(mixed(open_, low, 0.147155), 2.03608) / mixed(open_, low, 0.147155)) * -1, 3.33829), 16.7411),
        ) * -1,
        74: lambda: (
            rank(correlation(close, total(adv(30), 37.4843), 15.1365)) < rank(correlation(rank(mixed(high, vwap, 0.0261661)), rank(volume), 11.4791))
        ) * -1,
        75: lambda: rank(correlation(vwap, volume, 4.24304)) < rank(correlation(rank(low), rank(adv(50)), 12.4413)),
        76: lambda: larger(
            rank(decay_linear(delta(vwap, 1.24383), 11.8259)),
            ts_rank(decay_linear(ts_rank(correlation(indneutralize(low), adv(81), 8.14941), 19.569), 17.1543), 19.383),
        ) * -1,
        77: lambda: smaller(
            rank(decay_linear((((high + low) / 2) + high) - (vwap + high), 20.0451)), rank(decay_linear(correlation((high + low) / 2, adv(40), 3.1614), 5.64125))
        ),
        78: lambda: rank(correlation(total(mixed(low, vwap, 0.352233), 19.7428), total(adv(40), 19.7428), 6.83313))
        ** rank(correlation(rank(vwap), rank(volume), 5.77492)),
        79: lambda: rank(delta(indneutralize(mixed(close, open_, 0.60733)), 1.23438))
        < rank(correlation(ts_rank(vwap, 3.60973), ts_rank(adv(150), 9.18637), 14.6644)),
        80: lambda: (
            rank(sign(delta(indneutralize(mixed(open_, high, 0.868128)), 4.04545))) ** ts_rank(correlation(high, adv(10), 5.11456), 5.53756)
        ) * -1,
        81: lambda: (
            rank(log(product(rank(rank(correlation(vwap, total(adv(10), 49.6054), 8.47743)) ** 4), 14.9655)))
            < rank(correlation(rank(vwap), rank(volume), 5.07914))
        ) * -1,
        82: lambda: smaller(
            rank(decay_linear(delta(open_, 1.46063), 14.8717)),
            ts_rank(decay_linear(correlation(indneutralize(volume), mixed(open_, open_, 0.634196), 17.4842), 6.92131), 13.4283),
        ) * -1,
        83: lambda: (rank(delay((high - low) / (total(close, 5) / 5), 2)) * rank(rank(volume))) / (((high - low) / (total(close, 5) / 5)) / (vwap - close)),
        84: lambda: signedpower(ts_rank(vwap - ts_max(vwap, 15.3217), 20.7127), delta(close, 4.96796)),
        85: lambda: rank(correlation(mixed(high, close, 0.876703), adv(30), 9.61331))
        ** rank(correlation(ts_rank((high + low) / 2, 3.70596), ts_rank(volume, 10.1595), 7.11408)),
        86: lambda: (ts_rank(correlation(close, total(adv(20), 14.7444), 6.00049), 20.4195) < rank((open_ + close) - (vwap + open_))) * -1,
        87: lambda: larger(
            rank(decay_linear(delta(mixed(close, vwap, 0.369701), 1.91233), 2.65461)),
            ts_rank(decay_linear(absolute(correlation(indneutralize(adv(81)), close, 13.4132)), 4.89768), 14.4535),
        ) * -1,
        88: lambda: smaller(
            rank(decay_linear((rank(open_) + rank(low)) - (rank(high) + rank(close)), 8.06882)),
            ts_rank(decay_linear(correlation(ts_rank(close, 8.44728), ts_rank(adv(60), 20.6966), 8.01266), 6.65053), 2.61957),
        ),
        89: lambda: ts_rank(decay_linear(correlation(mixed(low, low, 0.967285), adv(10), 6.94279), 5.51607), 3.79744)
        - ts_rank(decay_linear(delta(indneutralize(vwap), 3.48158), 10.1466), 15.3012),
        90: lambda: (rank(close - ts_max(close, 4.66719)) ** ts_rank(correlation(indneutralize(adv(40)), low, 5.38375), 3.21856)) * -1,
        91: lambda: (
            ts_rank(decay_linear(decay_linear(correlation(indneutralize(close), volume, 9.74928), 16.398), 3.83219), 4.8667)
            - rank(decay_linear(correlation(vwap, adv(30), 4.01303), 2.6809))
        ) * -1,
        92: lambda: smaller(
            ts_rank(decay_linear((((high + low) / 2) + close) < (low + open_), 14.7221), 18.8683),
            ts_rank(decay_linear(correlation(rank(low), rank(adv(30)), 7.58555), 6.94024), 6.80584),
        ),
        93: lambda: ts_rank(decay_linear(correlation(indneutralize(vwap), adv(81), 17.4193), 19.848), 7.54455)
        / rank(decay_linear(delta(mixed(close, vwap, 0.524434), 2.77377), 16.2664)),
        94: lambda: (
            rank(vwap - ts_min(vwap, 11.5783)) ** ts_rank(correlation(ts_rank(vwap, 19.6462), ts_rank(adv(60), 4.02992), 18.0926), 2.70756)
        ) * -1,
        95: lambda: rank(open_ - ts_min(open_, 12.4105))
        < ts_rank(rank(correlation(total((high + low) / 2, 19.1351), total(adv(40), 19.1351), 12.8742)) ** 5, 11.7584),
        96: lambda: larger(
            ts_rank(decay_linear(correlation(rank(vwap), rank(volume), 3.83878), 4.16783), 8.38151),
            ts_rank(decay_linear(ts_argmax(correlation(ts_rank(close, 7.45404), ts_rank(adv(60), 4.13242), 3.65459), 12.6556), 14.0365), 13.4143),
        ) * -1,
        97: lambda: (
            rank(decay_linear(delta(indneutralize(mixed(low, vwap, 0.721001)), 3.3705), 20.4523))
            - ts_rank(decay_linear(ts_rank(correlation(ts_rank(low, 7.87871), ts_rank(adv(60), 17.255), 4.97547), 18.5925), 15.7152), 6.71659)
        ) * -1,
        98: lambda: rank(decay_linear(correlation(vwap, total(adv(5), 26.4719), 4.58418), 7.18088))
        - rank(decay_linear(ts_rank(ts_argmin(correlation(rank(open_), rank(adv(15)), 20.8187), 8.62571), 6.95668), 8.07206)),
        99: lambda: (rank(correlation(total((high + low) / 2, 19.8975), total(adv(60), 19.8975), 8.8136)) < rank(correlation(low, volume, 6.28259))) * -1,
        100: lambda: 0
        - (
            1
            * (
                ((1.5 * scale(indneutralize(indneutralize(rank(place()))))) - scale(indneutralize(correlation(close, rank(adv(20)), 5) - rank(ts_argmin(close, 30)))))
                * (volume / adv(20))
            )
        ),
        101: lambda: (close - open_) / ((high - low) + 0.001),
    }
