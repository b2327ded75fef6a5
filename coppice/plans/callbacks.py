"""Callbacks of the training loop: hooks at its begin, after each round and at its end."""

from __future__ import annotations

import copy
import json
import time
import warnings
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class TrainingState:
    model: object
    round_idx: int = 0
    n_rounds: int = 0
    train_loss: float | None = None
    val_loss: float | None = None
    extra: dict = field(default_factory=dict)


class Callback:
    """Hooks; on_round_end returns False to stop training. needs_loss: whether losses are computed for it."""

    needs_loss = True

    def on_train_begin(self, state: TrainingState) -> None: ...

    def on_round_begin(self, state: TrainingState) -> None: ...

    def on_round_end(self, state: TrainingState) -> bool:
        return True

    def on_train_end(self, state: TrainingState) -> None: ...


class CallbackManager:
    def __init__(self, callbacks=None):
        self.callbacks = list(callbacks or [])

    @property
    def needs_loss(self) -> bool:
        return any(c.needs_loss for c in self.callbacks)

    def begin(self, state):
        for c in self.callbacks:
            c.on_train_begin(state)

    def round_begin(self, state):
        for c in self.callbacks:
            c.on_round_begin(state)

    def round_end(self, state) -> bool:
        """Every callback is told; training goes on if none returned False."""
        return all([c.on_round_end(state) is not False for c in self.callbacks])

    def end(self, state):
        for c in self.callbacks:
            c.on_train_end(state)


class EarlyStopping(Callback):
    """Stops when the validation loss (training loss without one) has not improved by min_delta for patience rounds;
    restores the trees of the best round. Sets best_iteration_ and best_score_ on the model."""

    def __init__(self, patience: int = 50, min_delta: float = 0.0, restore_best: bool = True, verbose: bool = False):
        self.patience, self.min_delta, self.restore_best, self.verbose = patience, min_delta, restore_best, verbose

    def on_train_begin(self, state):
        self.best, self.at, self.kept, self.stopped = None, -1, None, False

    def on_round_end(self, state):
        loss = state.val_loss if state.val_loss is not None else state.train_loss
        if loss is None:
            return True
        if self.best is None or loss < self.best - self.min_delta:
            self.best, self.at = loss, state.round_idx
            self.kept = copy.deepcopy(state.model.state()) if self.restore_best else None
        elif state.round_idx - self.at >= self.patience:
            self.stopped = True
            if self.verbose:
                print(f"stopped in round {state.round_idx}; the best was {self.at}: {self.best:.6g}")
            return False
        return True

    def on_train_end(self, state):
        state.model.best_iteration_, state.model.best_score_ = self.at, self.best
        if self.restore_best and self.kept is not None:
            state.model.restore(self.kept)


class Logger(Callback):
    def __init__(self, period: int = 1, show_train: bool = True, show_val: bool = True):
        self.period, self.show_train, self.show_val = max(1, period), show_train, show_val

    def on_round_end(self, state):
        if state.round_idx % self.period == 0:
            parts = [f"round {state.round_idx}"]
            if self.show_train and state.train_loss is not None:
                parts.append(f"train {state.train_loss:.6g}")
            if self.show_val and state.val_loss is not None:
                parts.append(f"val {state.val_loss:.6g}")
            print("  ".join(parts))
        return True


class HistoryCallback(Callback):
    def __init__(self):
        self.train_loss: list[float] = []
        self.val_loss: list[float] = []

    def on_round_end(self, state):
        if state.train_loss is not None:
            self.train_loss.append(state.train_loss)
        if state.val_loss is not None:
            self.val_loss.append(state.val_loss)
        return True


class ModelCheckpoint(Callback):
    """Saves the model to path, after each round or whenever the loss is the best so far."""

    def __init__(self, path: str, save_best_only: bool = True, verbose: bool = False):
        self.path, self.save_best_only, self.verbose, self.best = path, save_best_only, verbose, None

    def on_round_end(self, state):
        loss = state.val_loss if state.val_loss is not None else state.train_loss
        if not self.save_best_only or loss is None or self.best is None or loss < self.best:
            self.best = loss
            state.model.save(self.path, overwrite=True)
            if self.verbose:
                print(f"saved round {state.round_idx} to {self.path}")
        return True


class LearningRateScheduler(Callback):
    """The rate of a round is the first rate times schedule(round). Trees keep the rate they were grown at."""

    needs_loss = False

    def __init__(self, schedule):
        self.schedule = schedule

    def on_train_begin(self, state):
        self.first = state.model.learning_rate

    def on_round_begin(self, state):
        state.model.round_rate_ = self.first * self.schedule(state.round_idx)


class ProfilingCallback(Callback):
    """Seconds of each round, as a JSON report in output_dir, compared with the last one there."""

    needs_loss = False

    def __init__(self, output_dir: str = "logs", compare_last: bool = True):
        self.output_dir, self.compare_last, self.report = Path(output_dir), compare_last, None

    def on_train_begin(self, state):
        self.began, self.rounds = time.perf_counter(), []

    def on_round_begin(self, state):
        self.round_began = time.perf_counter()

    def on_round_end(self, state):
        self.rounds.append(time.perf_counter() - self.round_began)
        return True

    def on_train_end(self, state):
        self.report = {"model": type(state.model).__name__, "total_s": time.perf_counter() - self.began, "rounds": len(self.rounds), "round_s": self.rounds}
        self.output_dir.mkdir(parents=True, exist_ok=True)
        before = sorted(self.output_dir.glob("profile_*.json"))
        if self.compare_last and before:
            last = json.loads(before[-1].read_text())
            self.report["last_total_s"] = last["total_s"]
        (self.output_dir / f"profile_{time.time_ns()}.json").write_text(json.dumps(self.report))


def profile_summary(report: dict) -> str:
    n = max(1, report["rounds"])
    text = f"{report['model']}: {report['total_s']:.2f} s, {report['rounds']} rounds, {sum(report['round_s']) / n:.3f} s each"
    return text + (f"; last time {report['last_total_s']:.2f} s" if "last_total_s" in report else "")


def warn_without_eval(callbacks, eval_set) -> None:
    if not eval_set and any(isinstance(c, EarlyStopping) for c in callbacks or []):
        warnings.warn("early stopping without an eval_set watches the training loss", stacklevel=3)
