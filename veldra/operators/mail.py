"""Mail as a sink: HTML messages with attachments, one connection per partition, an outbox of what became of each."""

from __future__ import annotations

import smtplib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.message import EmailMessage
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "status string, recipient string, subject string, error string"


@dataclass(frozen=True)
class Sender:
    """Where mail goes out. ``connect`` makes what has ``send_message`` and ``quit``; by default a server with STARTTLS and a login."""

    address: str
    name: str = ""
    host: str = "localhost"
    port: int = 587
    password: str = ""
    pause: float = 0.0
    dry_run: bool = True
    connect: Callable[[Sender], Any] | None = None

    def open(self) -> Any:
        if self.connect:
            return self.connect(self)
        server = smtplib.SMTP(self.host, self.port, timeout=30)
        server.starttls()
        server.login(self.address, self.password)
        return server


def message(sender: Sender, recipient: str, subject: str, html: str, attachments: list[str] | None = None) -> EmailMessage:
    """A message with an HTML body; attachments that aren't there are left out."""
    m = EmailMessage()
    m["From"] = f"{sender.name} <{sender.address}>" if sender.name else sender.address
    m["To"] = recipient
    m["Subject"] = " ".join((subject or "Weather Alert").split())
    m.set_content(html or "", subtype="html")
    for path in attachments or []:
        if Path(path).is_file():
            m.add_attachment(Path(path).read_bytes(), maintype="application", subtype="octet-stream", filename=Path(path).name)
    return m


def send(rows: DataFrame, sender: Sender) -> DataFrame:
    """``rows`` (recipient, subject, html, and attachments ARRAY<STRING> if any): ``(status, recipient, subject, error)``, sent, failed or dry_run.

    Lazy: mail goes out where the result is written, so write it once. A failed message doesn't stop the others.
    """
    attachments = F.col("attachments") if "attachments" in rows.columns else F.lit(None).cast("array<string>").alias("attachments")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server = None
        try:
            for batch in batches:
                out = []
                for recipient, subject, html, files in batch.itertuples(index=False):
                    status, error = "dry_run", None
                    if not sender.dry_run:
                        try:
                            server = server or sender.open()
                            server.send_message(message(sender, recipient, subject, html, None if files is None else list(files)))
                            status = "sent"
                        except (OSError, smtplib.SMTPException) as e:
                            status, error, server = "failed", str(e), None
                        if sender.pause:
                            time.sleep(sender.pause)
                    out.append((status, recipient, subject or "Weather Alert", error))
                yield pd.DataFrame(out, columns=["status", "recipient", "subject", "error"])
        finally:
            if server is not None:
                server.quit()

    return rows.select("recipient", "subject", "html", attachments).mapInPandas(run, RESULT)
