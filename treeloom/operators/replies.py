"""Replies as rows: stock and error pages, what a method and a context make of a reply, static files, login and logout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import password_matches
from ..functions.strings import escape_xml
from ..plans.loader import Templates
from ..plans.template import Template
from .web import REASONS, issue_token, mime_type, safe_redirect

#: What an error means, in a sentence.
DESCRIPTIONS = {400: "The request could not be understood.", 401: "You have to log in to see this page.", 403: "You may not see this page.", 404: "There is nothing at this address.", 405: "This address does not take such requests.", 500: "An error occurred while the page was made."}
_CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"


def _named(names: Mapping[int, str], status: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), status), F.lit(otherwise))


def stock(status: Column, message: Column) -> Column:
    """struct(status, reason, headers, body): a page with the status's reason and, where there is one, a message without control characters; 304 has no body."""
    reason = _named(REASONS, status, "Error")
    said = F.regexp_replace(F.coalesce(message, F.lit("")), _CONTROLS, "")
    page = F.concat(F.lit("<html><body><h1>"), reason, F.lit("</h1>"), F.when(said != "", F.concat(F.lit("<p>"), escape_xml(said), F.lit("</p>"))).otherwise(""), F.lit("</body></html>"))
    body = F.when(status == 304, "").otherwise(page)
    headers = F.when(status != 304, F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(body).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.struct(status.alias("status"), reason.alias("reason"), headers.alias("headers"), body.alias("body"))


def served(reply: Column, method: Column, context: str = "") -> Column:
    """What is sent of a reply: HEAD and OPTIONS have no body, and a redirection (301, 302) to a local address begins with the context's name."""
    empty = method.isin("HEAD", "OPTIONS")
    out = reply.withField("body", F.when(empty, "").otherwise(reply["body"]))
    if not context:
        return out
    local = reply["status"].isin(301, 302) & F.startswith(F.try_element_at(reply["headers"], F.lit("Location")), F.lit("/"))
    moved = F.transform_values(reply["headers"], lambda k, v: F.when(local & (k == "Location"), F.concat(F.lit(context), v)).otherwise(v))
    return out.withField("headers", moved)


def error_model(status: Column, message: Column, method: Column, uri: Column, username: Column) -> Column:
    """struct(nr, head, description, message, request(method, uri, username)), which an error page shows."""
    return F.struct(
        status.alias("nr"), _named(REASONS, status, "Error").alias("head"), _named(DESCRIPTIONS, status, "An error occurred.").alias("description"), message.alias("message"),
        F.struct(method.alias("method"), uri.alias("uri"), username.alias("username")).alias("request"),
    )


def error_pages(df: DataFrame, error: str = "error", templates: Mapping[str, str] | None = None, name: str = "error") -> Column:
    """The page of each row's error model by a template; the library's own where there is no other."""
    found = Templates(templates or {})
    return Template(found[name], dict(found)).render(df.select(F.col(error).alias("error")) if error != "error" else df)


def static(requests: DataFrame, files: DataFrame, path: str = "path", since: str = "since") -> DataFrame:
    """Requests with status, content_type and content (bytes): 404 without a file, 304 where it is not newer than `since` (timestamp, may be null), else 200 and the file.

    files: path, modified, content, as file_table reads them; equal paths of several requests read a file once.
    """
    found = requests.join(files.select(F.col("path").alias("_file"), "modified", "content"), F.ltrim(F.col(path), F.lit("/")) == F.col("_file"), "left")
    seconds = F.date_trunc("second", "modified")  # dates of messages have no parts of a second
    status = F.when(F.col("_file").isNull(), 404).when(seconds <= F.col(since), 304).otherwise(200)
    return found.select(*requests.columns, status.alias("status"), F.when(status == 200, mime_type(F.col("_file"))).alias("content_type"), F.when(status == 200, F.col("content")).alias("content"))


def file_table(spark, folder: str) -> DataFrame:
    """path (inside the folder), modified and content of every file below a folder in any store."""
    top = "/" + folder.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split(F.col("path"), F.lit("\\Q" + top + "\\E"), 2), -1).alias("path"), F.col("modificationTime").alias("modified"), "content")


def login(requests: DataFrame, users: DataFrame, secret: Column, now: Column, seconds: int = 86_400, templates: Mapping[str, str] | None = None) -> DataFrame:
    """The requests with status, location, cookie and page of a login.

    requests: username, password, uri (where to go then), csrf (sent) and own_csrf (of the cookie); users: username, stored (see
    codec.encode_password) and role (array). 403 where csrf differs; 303 with a signed token in a cookie where the password is right; else 200 and the form
    again with the name. An unknown user is as one with a wrong password.
    """
    u = users.select(F.col("username").alias("_user"), "stored", "role")
    rows = requests.join(u, F.col("username") == F.col("_user"), "left").withColumn("_right", F.coalesce(password_matches(F.col("stored"), F.col("password")), F.lit(False)))
    same = F.coalesce(F.col("csrf") == F.col("own_csrf"), F.lit(False))
    rows = rows.withColumn("status", F.when(~same, 403).when(F.col("_right"), 303).otherwise(200)).withColumn("failed", F.col("status") == 200)
    claims = F.to_json(F.struct("username", "role", (now + seconds).alias("exp")))
    inside = F.col("status") == 303
    page = Template(Templates(templates or {})["login"]).render(rows)
    cookie = F.concat(F.lit("access_token="), issue_token(claims, secret), F.lit("; HttpOnly; SameSite=Lax; Path=/"))
    return rows.select(*requests.columns, "status", F.when(inside, safe_redirect(F.coalesce("uri", F.lit("/")))).alias("location"), F.when(inside, cookie).alias("cookie"), F.when(F.col("failed"), page).alias("page"))


def logout(uri: Column) -> Column:
    """struct(status, location, cookie): the token's cookie is dropped, and a local address or / follows."""
    return F.struct(F.lit(303).alias("status"), safe_redirect(F.coalesce(uri, F.lit("/"))).alias("location"), F.lit("access_token=; Max-Age=0; Path=/").alias("cookie"))
