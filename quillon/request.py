"""The request algebra: what a comparison query asks for, and how it is dispatched."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field, fields, replace

from .catalogue import KIND_LEGENDS, LEGENDS, axis_title

AXES = ("results", "m_parameters", "fps", "pub_date", "gflops")
#: Axes whose values spread over orders of magnitude.
LOG_AXES = ("fps", "m_parameters", "gflops")
KINDS = {
    "classification": "classification",
    "detection": "instance",
    "instance": "instance",
    "semantic": "semantic",
    "Classification": "classification",
    "Object Detection": "instance",
    "Instance Segmentation": "instance",
    "Semantic Segmentation": "semantic",
}


class QueryType(enum.Enum):
    SINGLE = "single"
    MULTI = "multi"
    NONE = "none"


@dataclass(frozen=True)
class DataArgs:
    """What one axis' facts are restricted to; None restricts nothing."""

    dataset: str | None = None
    task: str | None = None
    head: str | None = None
    resolution: int | None = None
    gpu: str | None = None
    precision: str | None = None

    @property
    def fps(self) -> bool:
        return self.gpu is not None and self.precision is not None

    @property
    def kind(self) -> str | None:
        return KINDS.get(self.task) if self.task else None


@dataclass(frozen=True)
class AxisArgs:
    """An axis with the metric that stands for results."""

    axis: str
    metric: str | None = None

    @property
    def attribute(self) -> str:
        return self.metric or self.axis


@dataclass(frozen=True)
class Request:
    x: AxisArgs
    y: AxisArgs
    x_args: DataArgs = field(default_factory=DataArgs)
    y_args: DataArgs = field(default_factory=DataArgs)
    family: str | None = None
    pretrain_dataset: str | None = None
    pretrain_method: str | None = None
    group_by: str | None = None
    group_by_second: str | None = None

    def __post_init__(self):
        # a second key alone is the first
        if self.group_by_second and not self.group_by:
            object.__setattr__(self, "group_by", self.group_by_second)
            object.__setattr__(self, "group_by_second", None)

    @property
    def args(self) -> DataArgs:
        """Both axes' restrictions in one: x's where set, else y's."""
        return DataArgs(**{f.name: getattr(self.x_args, f.name) if getattr(self.x_args, f.name) is not None else getattr(self.y_args, f.name) for f in fields(DataArgs)})

    @property
    def title_dataset(self) -> str | None:
        return self.y_args.dataset or self.x_args.dataset

    @property
    def query_type(self) -> QueryType:
        a, b = self.x_args, self.y_args
        if a.dataset and b.dataset and a.task and b.task:
            same = (a.dataset, a.task, a.head) == (b.dataset, b.task, b.head)
            return QueryType.SINGLE if same else QueryType.MULTI
        return QueryType.SINGLE if a.dataset or b.dataset else QueryType.NONE

    def problems(self) -> list[str]:
        """What keeps the request from being ready; empty if it is."""
        out = []
        for name, own, other, args in (("x", self.x, self.y, self.x_args), ("y", self.y, self.x, self.y_args)):
            if own.axis not in AXES:
                out.append(f"{name}: no axis {own.axis!r}")
            if own.axis == "gflops" and other.axis != "results":
                out.append(f"{name}: gflops needs results on the other axis")
            if own.axis == "results":
                out += [f"{name}: results need a {k}" for k, v in (("task", args.task), ("dataset", args.dataset), ("metric", own.metric)) if not v]
            if own.axis == "fps" and not args.fps:
                out.append(f"{name}: fps needs gpu and precision")
        if self.group_by and self.group_by == self.group_by_second:
            out.append("both legend keys are the same")
        offered = self.legends()
        out += [f"no legend key {k!r} for these tasks" for k in (self.group_by, self.group_by_second) if k and "." in k and k not in offered]
        return out

    def legends(self) -> dict[str, str]:
        """Legend keys and their labels that the request's tasks offer."""
        kinds = dict.fromkeys(a.kind for a in (self.x_args, self.y_args) if a.kind)
        return dict(LEGENDS) | {k: v for kind in KIND_LEGENDS if kind in kinds for k, v in KIND_LEGENDS[kind].items()}

    def log_axes(self) -> tuple[bool, bool]:
        """Whether the x and the y axis are drawn on a logarithmic scale."""
        return self.x.attribute in LOG_AXES, self.y.attribute in LOG_AXES

    def scoped(self, family: str | None = None, head: str | None = None, dataset: str | None = None) -> Request:
        """The request as a page of one family, head or dataset asks it."""
        out = self
        if family is not None:
            out = replace(out, family=family)
        if head is not None:
            out = replace(out, x_args=replace(out.x_args, head=head), y_args=replace(out.y_args, head=head))
        if dataset is not None:
            out = replace(out, x_args=replace(out.x_args, dataset=dataset), y_args=replace(out.y_args, dataset=dataset))
        return out


def _text(value) -> str | None:
    return str(value) if value not in (None, "") else None


def parse(form: dict) -> Request:
    """A request from form fields (x_axis, x_metric, x_task, ..., legend, legend_second); empty fields are unset."""

    def data(p: str) -> DataArgs:
        resolution = _text(form.get(f"{p}_resolution"))
        return DataArgs(_text(form.get(f"{p}_dataset")), _text(form.get(f"{p}_task")), _text(form.get(f"{p}_head")), int(resolution) if resolution else None, _text(form.get(f"{p}_gpu")), _text(form.get(f"{p}_precision")))

    def axis(p: str) -> AxisArgs:
        return AxisArgs(_text(form.get(f"{p}_axis")) or "", _text(form.get(f"{p}_metric")))

    return Request(axis("x"), axis("y"), data("x"), data("y"), _text(form.get("family")), _text(form.get("pretrain_dataset")), _text(form.get("pretrain_method")), _text(form.get("legend")), _text(form.get("legend_second")))


def default(metrics: dict[str, tuple[str, ...]], dataset: str = "ImageNet-1k", task: str = "Classification") -> Request:
    """The first metric of a task on a dataset against cost, by family."""
    args = DataArgs(dataset, task)
    return Request(AxisArgs("gflops"), AxisArgs("results", metrics[KINDS[task]][0]), DataArgs(), args, group_by="family")


def title(attribute: str, task: str | None = None, dataset: str | None = None, labels: dict[str, str] | None = None, suffix: bool = False) -> str:
    """A plot axis' title: by label, else as the catalogue calls it, cut at a markup entity, with the dataset where several are compared."""
    text = ((labels or {}).get(attribute) or axis_title(attribute, task, dataset)).split("&", 1)[0]
    return f"{text} ({dataset})" if suffix and dataset else text


def table_titles(x: str, y: str, request: Request) -> tuple[str, str]:
    """Distinct column names of a table: by dataset where these differ, else by head, else by axis."""
    if x != y:
        return x, y
    a, b = request.x_args, request.y_args
    if a.dataset != b.dataset:
        return f"{x} ({a.dataset})", f"{y} ({b.dataset})"
    if a.head != b.head:
        return f"{x} ({a.head})", f"{y} ({b.head})"
    return f"{x} (x)", f"{y} (y)"
