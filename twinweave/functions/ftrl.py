"""FTRL-Proximal logistic learning as Catalyst expressions.

Scores are ``2 / (1 + exp(-w.x)) - 1``, written as ``tanh(w.x / 2)``.  A learner state
is a struct ``z, n, w, trained``; folding ``step`` over an ordered array of examples
is the sequential learner, without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinweave.config import FtrlParams
from twinweave.functions.text import let

_EDGE = 1e-12


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(w: Column, x: Column) -> Column:
    return _total(F.zip_with(w, x, lambda a, b: a * b))


def mean(x: Column) -> Column:
    return F.try_divide(_total(x), F.size(x).cast("double"))


def logistic(w: Column, x: Column) -> Column:
    return F.tanh(dot(w, x) / 2.0)


def score(w: Column, trained: Column, x: Column) -> Column:
    """Model output; the mean of the vector while the model is untrained."""
    return F.when(trained, logistic(w, x)).otherwise(mean(x))


def loss(y: Column, predicted: Column, clip: bool = True) -> Column:
    """Cross entropy of an output that may lie in (-1, 1).

    ``clip`` moves the output into (0, 1) first.  Without it a negative output counts
    as no loss at all, whatever the label.
    """
    inside = F.greatest(F.lit(_EDGE), F.least(F.lit(1.0 - _EDGE), predicted))
    entropy = -y * F.ln(inside) - (1.0 - y) * F.ln(1.0 - inside)
    return entropy if clip else F.when(predicted < 0.0, 0.0).otherwise(entropy)


def weights(z: Column, n: Column, p: FtrlParams) -> Column:
    def one(zi, ni):
        active = (F.signum(zi) * p.l1 - zi) / (p.l2 + (p.beta + F.sqrt(ni)) / p.alpha)
        return F.when(F.abs(zi) <= p.l1, 0.0).otherwise(active)

    return F.zip_with(z, n, one)


def zero_state(dim: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.struct(
        zeros.alias("z"), zeros.alias("n"), zeros.alias("w"), F.lit(False).alias("trained")
    )


def batch_step(state: Column, g: Column, p: FtrlParams) -> Column:
    """The state after one step of the summed gradient ``g``."""
    n = F.zip_with(state["n"], g, lambda ni, gi: ni + gi * gi)
    sigma = F.zip_with(state["n"], g, lambda ni, gi: (F.sqrt(ni + gi * gi) - F.sqrt(ni)) / p.alpha)

    def stepped(w):
        moved = F.zip_with(sigma, w, lambda a, b: a * b)
        z = F.zip_with(F.zip_with(state["z"], g, lambda a, b: a + b), moved, lambda a, b: a - b)
        return F.struct(z.alias("z"), n.alias("n"), w.alias("w"), F.lit(True).alias("trained"))

    return let(weights(state["z"], state["n"], p), stepped)


def _advance(state: Column, x: Column, y: Column, p: FtrlParams, body) -> Column:
    """One update; ``body(z, n, w, predicted)`` builds the result."""
    def with_output(w, predicted):
        error = predicted - y
        squares = F.zip_with(state["n"], x, lambda ni, xi: ni + error * error * xi * xi)

        def with_squares(n_new):
            moved = F.zip_with(
                F.zip_with(state["n"], n_new, lambda a, b: (F.sqrt(b) - F.sqrt(a)) / p.alpha), w,
                lambda sigma, wi: sigma * wi,
            )
            pushed = F.zip_with(state["z"], x, lambda zi, xi: zi + error * xi)
            z_new = F.zip_with(pushed, moved, lambda a, b: a - b)
            return body(z_new, n_new, w, predicted)

        return let(squares, with_squares)

    return let(
        weights(state["z"], state["n"], p),
        lambda w: let(score(w, state["trained"], x), lambda out: with_output(w, out)),
    )


def one_pass(examples: Column, start: Column, p: FtrlParams) -> Column:
    """Fold an ordered ``array<struct<x, y>>`` into a state."""
    def merge(state, e):
        return _advance(state, e["x"], e["y"], p, lambda z, n, w, _: F.struct(
            z.alias("z"), n.alias("n"), w.alias("w"), F.lit(True).alias("trained")
        ))

    return F.aggregate(examples, start, merge)


def until_settled(examples: Column, start: Column, p: FtrlParams) -> Column:
    """Cycle over the examples until ``epochs`` losses in a row are below ``eta``.

    Stops after ``max_iter`` updates at the latest.  The state gains ``streak`` and
    ``updates``.
    """
    first = F.struct(
        start["z"].alias("z"), start["n"].alias("n"), start["w"].alias("w"),
        start["trained"].alias("trained"), F.lit(0).alias("streak"), F.lit(0).alias("updates"),
    )

    def merge(state, i):
        e = F.element_at(examples, (i % F.size(examples)) + 1)
        moved = let(e, lambda ex: _advance(
            state, ex["x"], ex["y"], p,
            lambda z, n, w, out: F.struct(
                z.alias("z"), n.alias("n"), w.alias("w"), F.lit(True).alias("trained"),
                F.when(loss(ex["y"], out, p.clip_loss) < p.eta, state["streak"] + 1)
                .otherwise(0).alias("streak"),
                (state["updates"] + 1).alias("updates"),
            ),
        ))
        return F.when(state["streak"] >= p.epochs, state).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(p.max_iter - 1)), first, merge)
