"""Literature sources: saved responses of eight services, each normalised to the common record.

There is no network here; a fetcher that fills a table (module, body) of responses is a plug-in, with its own time
budget and retries. Normalising is native: JSON by explicit schemas, XML by XPath. Unknown modules give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import PAPER


def _record(module: str, **columns: Column) -> list[Column]:
    fields = {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPER.fields}
    fields["source_module"] = F.lit(module).alias("source_module")
    return list(fields.values())


def _json(df: DataFrame, schema: str, path: str) -> DataFrame:
    return df.select(F.from_json("body", schema).alias("r")).select(F.explode(f"r.{path}").alias("x"))


def inverted_text(index: Column) -> Column:
    """Text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def crossref(df: DataFrame) -> DataFrame:
    schema = "message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,`is-referenced-by-count`:long,URL:string,abstract:string,language:string,type:string>>>"
    names = F.transform("x.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    x = _json(df, schema, "message.items")
    return x.select(*_record("crossref", doi=F.col("x.DOI"), title=F.get("x.title", F.lit(0)), authors=names, year=F.get(F.get("x.issued.`date-parts`", F.lit(0)), F.lit(0)), venue=F.get("x.`container-title`", F.lit(0)), citations=F.col("x.`is-referenced-by-count`"), url=F.col("x.URL"), abstract=F.col("x.abstract"), language=F.col("x.language"), publication_types=F.array("x.type")))


def openalex(df: DataFrame) -> DataFrame:
    schema = "results array<struct<id:string,doi:string,display_name:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,primary_location:struct<source:struct<display_name:string>>,cited_by_count:long,fwci:double,abstract_inverted_index:map<string,array<int>>,open_access:struct<oa_url:string>,is_retracted:boolean,language:string,type:string>>"
    x = _json(df, schema, "results")
    return x.select(*_record("openalex", doi=F.col("x.doi"), title=F.col("x.display_name"), authors=F.transform("x.authorships", lambda a: a["author"]["display_name"]), year=F.col("x.publication_year"), venue=F.col("x.primary_location.source.display_name"), citations=F.col("x.cited_by_count"), citations_normalized=F.col("x.fwci"), url=F.col("x.id"), oa_url=F.col("x.open_access.oa_url"), is_retracted=F.col("x.is_retracted"), abstract=inverted_text(F.col("x.abstract_inverted_index")), language=F.col("x.language"), publication_types=F.array("x.type")))


def semantic_scholar(df: DataFrame) -> DataFrame:
    schema = "data array<struct<title:string,abstract:string,year:int,venue:string,citationCount:long,url:string,externalIds:map<string,string>,authors:array<struct<name:string>>,openAccessPdf:struct<url:string>,publicationTypes:array<string>>>"
    x = _json(df, schema, "data")
    return x.select(*_record("semantic_scholar", doi=F.try_element_at("x.externalIds", F.lit("DOI")), title=F.col("x.title"), authors=F.transform("x.authors", lambda a: a["name"]), year=F.col("x.year"), venue=F.col("x.venue"), citations=F.col("x.citationCount"), url=F.col("x.url"), oa_url=F.col("x.openAccessPdf.url"), abstract=F.col("x.abstract"), publication_types=F.col("x.publicationTypes")))


def base(df: DataFrame) -> DataFrame:
    schema = "response struct<docs:array<struct<dcdoi:array<string>,dctitle:string,dccreator:array<string>,dcyear:string,dcdescription:string,dcsource:string,dclink:string,dcoa:int,dclang:array<string>>>>"
    x = _json(df, schema, "response.docs")
    return x.select(*_record("base", doi=F.get("x.dcdoi", F.lit(0)), title=F.col("x.dctitle"), authors=F.col("x.dccreator"), year=F.col("x.dcyear").try_cast("int"), venue=F.col("x.dcsource"), url=F.col("x.dclink"), oa_url=F.when(F.col("x.dcoa") == 1, F.col("x.dclink")), abstract=F.col("x.dcdescription"), language=F.get("x.dclang", F.lit(0))))


def econbiz(df: DataFrame) -> DataFrame:
    schema = "hits struct<hits:array<struct<_source:struct<title:string,creator:array<string>,date:string,isPartOf:string,identifier_url:string,abstract:string,language:array<string>>>>>"
    x = _json(df, schema, "hits.hits")
    year = F.nullif(F.regexp_extract("x._source.date", r"(1\d{3}|2\d{3})", 1), F.lit("")).cast("int")
    return x.select(*_record("econbiz", title=F.col("x._source.title"), authors=F.col("x._source.creator"), year=year, venue=F.col("x._source.isPartOf"), url=F.col("x._source.identifier_url"), abstract=F.col("x._source.abstract"), language=F.get("x._source.language", F.lit(0))))


def dblp(df: DataFrame) -> DataFrame:
    schema = "result struct<hits:struct<hit:array<struct<info:struct<title:string,year:string,venue:string,doi:string,url:string,type:string,authors:struct<author:array<struct<text:string>>>>>>>>"
    x = _json(df, schema, "result.hits.hit")
    return x.select(*_record("dblp", doi=F.col("x.info.doi"), title=F.rtrim("x.info.title", F.lit(".")), authors=F.transform("x.info.authors.author", lambda a: a["text"]), year=F.col("x.info.year").try_cast("int"), venue=F.col("x.info.venue"), url=F.col("x.info.url"), publication_types=F.array("x.info.type")))


def _entries(df: DataFrame, tag: str) -> DataFrame:
    """One row per element of a feed; name spaces are dropped, as XPath here knows none."""
    plain = F.regexp_replace(F.regexp_replace("body", r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")
    plain = F.regexp_replace(plain, r"\s\w+:(\w+=)", " $1")
    return df.select(F.explode(F.regexp_extract_all(plain, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"))).alias("e"))


def arxiv(df: DataFrame) -> DataFrame:
    e = _entries(df, "entry")
    one = lambda p: F.trim(F.regexp_replace(F.xpath_string("e", F.lit(p)), r"\s+", " "))
    return e.select(*_record("arxiv", doi=F.nullif(one("entry/doi"), F.lit("")), title=one("entry/title"), authors=F.xpath("e", F.lit("entry/author/name/text()")), year=F.substring(one("entry/published"), 1, 4).try_cast("int"), venue=F.lit("arXiv"), url=one("entry/id"), oa_url=F.replace(one("entry/id"), F.lit("/abs/"), F.lit("/pdf/")), abstract=one("entry/summary")))


def econstor(df: DataFrame) -> DataFrame:
    """Its OAI-PMH feed of Dublin Core records."""
    e = _entries(df, "record")
    first = lambda p: F.nullif(F.trim(F.xpath_string("e", F.lit(p))), F.lit(""))
    ids = F.xpath("e", F.lit("//identifier/text()"))
    doi = F.get(F.filter(F.transform(ids, lambda i: F.nullif(F.regexp_extract(i, r"(10\.\d{4,9}/\S+)", 1), F.lit(""))), lambda i: i.isNotNull()), F.lit(0))
    url = F.get(F.filter(ids, lambda i: i.startswith("http")), F.lit(0))
    return e.select(*_record("econstor", doi=doi, title=first("//title"), authors=F.xpath("e", F.lit("//creator/text()")), year=F.substring(first("//date"), 1, 4).try_cast("int"), venue=first("//publisher"), url=url, oa_url=url, abstract=first("//description"), language=first("//language")))


MODULES: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (crossref, openalex, semantic_scholar, base, econbiz, econstor, arxiv, dblp)}


def normalize(responses: DataFrame, modules: tuple[str, ...] = tuple(MODULES)) -> DataFrame:
    """Records of all modules from saved responses (module, body)."""
    out = None
    for name in modules:
        part = MODULES[name](responses.where(F.col("module") == name).select("body"))
        out = part if out is None else out.unionByName(part)
    return out


class SavedResponses(DataSource):
    """spark.read.format("saved_responses").option("module", ...).load(path): whole files as (module, body).

    A Python data source for fetchers to build on; each path is one partition, read through the session's executors.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return "module string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.bodies = [v for k, v in sorted(options.items()) if k.startswith("body")]
        self.module = options.get("module", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(b) for b in self.bodies]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (self.module, partition.value)
