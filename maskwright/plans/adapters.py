"""Language models behind a service, asked by each task through a client of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "Keep every token in square brackets exactly as it is."


def service(connect: Callable[[], Any], ask: Callable[[Any, str], str | None]) -> Callable[[DataFrame, str, str], DataFrame]:
    """An adapter: connect() makes a task's client, ask(client, prompt) gets a reply. Both are sent to the
    workers. A null prompt is not asked and gives null; a reply of None gives the empty string; an error fails the task, which
    Spark runs again."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = None
        for batch in batches:
            client = client or connect()
            yield pd.Series([None if p is None else ask(client, p) or "" for p in batch], dtype=object)

    return lambda df, prompt, response: df.withColumn(response, run(F.col(prompt)))


def chat_completions(model: str, temperature: float = 0.0, system: str = SYSTEM) -> Callable[[Any, str], str | None]:
    """For clients with chat.completions.create."""
    return lambda client, prompt: client.chat.completions.create(model=model, temperature=temperature, messages=[{"role": "system", "content": system}, {"role": "user", "content": prompt}]).choices[0].message.content


def messages(model: str, max_tokens: int = 1024, temperature: float = 0.0, system: str = SYSTEM) -> Callable[[Any, str], str | None]:
    """For clients with messages.create."""
    return lambda client, prompt: "".join(x.text for x in client.messages.create(model=model, max_tokens=max_tokens, temperature=temperature, system=system, messages=[{"role": "user", "content": prompt}]).content)


def generate_content(model: str, system: str = SYSTEM) -> Callable[[Any, str], str | None]:
    """For clients with models.generate_content."""
    return lambda client, prompt: client.models.generate_content(model=model, contents=f"{system}\n\n{prompt}").text
