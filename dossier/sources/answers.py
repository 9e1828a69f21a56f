"""Answer providers for requests (key, field, chunk, prompt): recorded answers or an HTTP endpoint; validation with bounded retries."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import keyword_list as K
from .ledger import REQUEST, Ledger
from .shared import written

FAILED = "EXTRACTION_FAILED"


@dataclass(frozen=True)
class Settings:
    """Settings that the environment may override."""

    endpoint: str = "http://localhost:11434/v1"
    model: str = "local"
    timeout: float = 240
    list_timeout: float = 150
    list_tokens: int = 700
    option_chars: int = 20000
    attempts: int = 3

    @classmethod
    def from_env(cls, prefix: str = "DOSSIER_") -> Settings:
        kinds = {k: type(v) for k, v in cls().__dict__.items()}
        return cls(**{k: kinds[k](os.environ[prefix + k.upper()]) for k in kinds if prefix + k.upper() in os.environ})


class Answerer(Protocol):
    """Gives (text, finish_reason) columns for requests of one attempt."""

    def answer(self, requests: DataFrame, attempt: int) -> DataFrame: ...


class RecordedAnswers:
    """Answers from a table (key, field, chunk, attempt, text, finish_reason)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answer(self, requests: DataFrame, attempt: int) -> DataFrame:
        mine = self.table.where(F.col("attempt") == attempt).select(*REQUEST, "text", "finish_reason")
        return requests.join(mine, REQUEST, "left")


class Budget:
    """Independent budgets of retries by kind of error; an error's kind is told by its message."""

    def __init__(self, limits: dict[str, tuple[int, float]] | None = None):
        self.left = dict(limits or {"rate": (15, 30.0), "timeout": (2, 5.0), "other": (2, 5.0)})

    def spend(self, message: str) -> float | None:
        """Seconds to wait, or None if this kind of error may not occur again."""
        low = message.lower()
        kind = "rate" if "429" in low or "rate limit" in low else "timeout" if "timeout" in low or "timed out" in low else "other"
        n, wait = self.left[kind]
        self.left[kind] = (n - 1, wait)
        return wait if n > 1 else None

    @staticmethod
    def reason(message: str) -> str:
        return "timeout" if "timed out" in message.lower() or "timeout" in message.lower() else "error"


def post_chat(settings: Settings, messages: list[dict], temperature: float, timeout: float, tokens: int | None = None) -> tuple[str, str]:
    """One call of the chat endpoint: (text, finish reason)."""
    import urllib.request

    body = {"model": settings.model, "temperature": temperature, "messages": messages} | ({"max_tokens": tokens} if tokens else {})
    request = urllib.request.Request(f"{settings.endpoint}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        choice = json.load(r)["choices"][0]
    return choice["message"]["content"] or "", choice.get("finish_reason", "stop")


class HttpAnswers:
    """Chat endpoint; one client a partition. Concurrency is the number of partitions given.

    Requests have a prompt and a system message, and a field whose Call sets temperature, time-out and tokens; later attempts are made at temperature 0.
    """

    def __init__(self, settings: Settings, partitions: int = 4, budgets: dict[str, tuple[int, float]] | None = None):
        self.settings, self.partitions, self.budgets = settings, partitions, budgets

    def answer(self, requests: DataFrame, attempt: int) -> DataFrame:
        s, budgets = self.settings, self.budgets

        def call(field: str, prompt: str, system: str) -> tuple[str, str]:
            budget, kind = Budget(budgets), CALLS.get(field, Call("", ""))
            messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
            while True:
                try:
                    return post_chat(s, messages, kind.temperature if attempt == 1 else 0.0, s.list_timeout if kind.is_list else s.timeout, s.list_tokens if kind.is_list else None)
                except Exception as e:
                    wait = budget.spend(str(e))
                    if wait is None:
                        return FAILED, budget.reason(str(e))
                    time.sleep(wait)

        def run(batches):
            for pdf in batches:
                got = [call(*r) for r in zip(pdf["field"], pdf["prompt"], pdf["system"])]
                pdf["text"], pdf["finish_reason"] = [g[0] for g in got], [g[1] for g in got]
                yield pdf

        schema = ", ".join([*(f"`{n}` {t}" for n, t in requests.dtypes), "text string", "finish_reason string"])
        return requests.repartition(self.partitions).mapInPandas(run, schema)

    def preflight(self) -> tuple[bool, str]:
        """Whether the model answers a tiny request, and its answer or the error. A run that would fail everywhere should not begin."""
        try:
            return True, post_chat(self.settings, [{"role": "user", "content": "Say ready."}], 0.0, self.settings.timeout)[0].strip()
        except Exception as e:
            return False, f"{type(e).__name__}: {e}"


@dataclass(frozen=True)
class Call:
    """How one field is asked for, in our own words; {text} is the section and {drug} the product's name."""

    system: str
    template: str
    is_list: bool = False
    temperature: float = 0.1


def _list(what: str, aside: str = "") -> Call:
    return Call(
        f"You copy {what} out of drug labels. You never explain and never add anything that the text does not say.",
        f"Which {what} does this section name? Give them as short phrases divided by commas, on one line, in the section's own words{aside}. Give ******** if it names none.\n\n{{text}}",
        True,
    )


def _chunk_list(what: str) -> Call:
    return Call(f"You read part of a drug label and note {what}.", f"Part of the label of {{drug}} follows. Note each of the {what} in it once, divided by commas. Write NONE_FOUND if there are none in this part.\n\n{{text}}")


def _option(question: str, options: tuple[str, ...]) -> Call:
    return Call("You sort statements of drug labels into fixed categories. You answer with one category and nothing else.", f"{question} Choose one of: {'; '.join(options)}.\n\n{{text}}")


def _summary(what: str, temperature: float = 0.2) -> Call:
    return Call("You write for pharmacists, in plain and exact sentences.", f"Say in one paragraph what the section below reports about {what}. Leave out what it does not report.\n\n{{text}}", False, temperature)


#: Every call by field: those of the records, then those of the passages by chunk and by category.
CALLS = {
    "metadata": Call("You read title pages of drug labels.", "Read the title page below and give six lines, in this order: brand name, company, date of first authorisation, date of the last revision, ingredients, dosage forms. Write N/A on a line that has no answer.\n\n{text}"),
    "indications": _list("conditions that the drug is used for"),
    "contraindications": _list("conditions in which the drug must not be used"),
    "adverse_events": _list("adverse events", ", without frequencies"),
    "drug_interactions": _list("drugs and drug classes that interact with it"),
    "serious_warnings": Call("You copy warnings out of drug labels.", "Name the serious warnings of this section as short phrases divided by commas; give ****** if there are none.\n\n{text}"),
    "liver_dose": _option("Does the dose change where the liver's function is reduced?", C.LIVER_OPTIONS),
    "kidney_dose": _option("Does the dose change where the kidneys' function is reduced?", C.KIDNEY_OPTIONS),
    "pharmacokinetics": _summary("absorption, distribution and elimination"),
    "pharmacodynamics": _summary("how the drug acts"),
    "elimination": Call("You look up how drugs leave the body.", "Give two lines, `Urine elimination:` and `Faeces elimination:`, each with the share that this section states or with `not stated`.\n\n{text}"),
    "pregnancy_status": _option("What does the label advise about use in pregnancy?", C.PREGNANCY_OPTIONS),
    "pregnancy_summary": _summary("use in pregnancy", 0.3),
    "breastfeeding_status": _option("What does the label advise about use while breast-feeding?", C.BREASTFEEDING_OPTIONS),
    "breastfeeding_summary": _summary("use while breast-feeding", 0.3),
    "chunk_indications": _chunk_list("conditions that the drug is used for"),
    "chunk_contraindications": _chunk_list("conditions in which the drug must not be used"),
    "chunk_serious": _chunk_list("serious warnings"),
    "chunk_adverse": _chunk_list("adverse events"),
    "chunk_interactions": _chunk_list("drugs and classes that interact with it"),
}


def requested(df: DataFrame, field: str, text: str, drug: str | None = None, limit: int | None = None) -> DataFrame:
    """df with the field's name, its prompt (the section filled in, cut to `limit` characters) and its system message. A null section is an empty one."""
    call = CALLS[field]
    section = F.coalesce(F.col(text), F.lit(""))
    section = F.substring(section, 1, limit) if limit else section
    parts = re.split(r"(\{text\}|\{drug\})", call.template)
    value = {"{text}": section, "{drug}": F.coalesce(F.col(drug), F.lit("")) if drug else F.lit("the drug")}
    prompt = F.concat(*[value.get(p, F.lit(p)) for p in parts])
    return df.withColumns({"field": F.lit(field), "prompt": prompt, "system": F.lit(call.system)})


def validated(requests: DataFrame, answerer: Answerer, source: str | None = None, attempts: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """requests with value, reason and attempt: the first attempt whose answer meets the list contract. Only requests without one are asked again, with the reason.

    Each attempt's answers are written to the ledger before they are judged, so a request is asked once an attempt, whatever is
    done with the result, and a ledger that has answers already is gone on with. The judgements are written, too: the list contract is worked out once for
    each answer. An answer that was cut off loses what follows its last comma. When no
    attempt is valid the value is EXTRACTION_FAILED; prose is never returned.
    """
    ledger = ledger or Ledger(requests.sparkSession)
    columns, left, done, last = requests.columns, requests, None, None
    for attempt in range(1, attempts + 1):
        if attempt > 1 and left.isEmpty():
            break
        got = ledger.ask(left, attempt, answerer.answer, F.col("text") == FAILED)
        cut = F.when(F.col("finish_reason") == "length", F.regexp_replace("text", r",[^,]*$", "")).otherwise(F.col("text"))
        checked = K.normalize(got.withColumn("text", cut), "text", source).withColumn("attempt", F.lit(attempt))
        checked = written(checked.select(*columns, "value", "reason", "attempt"), "judged")
        good = checked.where("reason = 'ok'")
        done = good if done is None else done.unionByName(good)
        last = checked.where("reason <> 'ok'")
        left = last.select(*columns)
        if "prompt" in columns:
            again = F.concat(F.col("prompt"), F.lit("\n\nYour last answer was refused: "), F.col("reason"), F.lit(". Give only the list."))
            left = last.withColumn("prompt", again).select(*columns)
    return done.unionByName(last.withColumn("value", F.lit(FAILED)))
