"""Check digits and structures of identifiers as Column builders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that look like a bank identifier.
SWIFT_WORDS = ("CONSEGUE", "CONSIGNA", "CONSELHE", "CONSEJOS", "CONSULTE", "CONTINUE", "CONTEXTO", "CONTRATE", "CONTROLE", "CONVERSE", "COMPLETE", "COMPARTE", "COMPROVE")


@lru_cache
def swift_countries() -> tuple[str, ...]:
    """Country codes of bank identifiers: those of ISO 3166 as the JVM has them, and Kosovo's."""
    return (*SparkContext._active_spark_context._jvm.java.util.Locale.getISOCountries(), "XK")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _array(d: Column) -> Column:
    return F.transform(F.split(d, ""), lambda x: x.cast("int"))


def _weighted(d: Column, weights: Sequence[int]) -> Column:
    """Sum of leading digits times weights."""
    own = F.slice(_array(d), 1, len(weights))
    return F.aggregate(F.zip_with(own, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda s, x: s + x)


def _digit(d: Column, k: int) -> Column:
    return F.substring(d, k, 1).try_cast("int")


def _varied(d: Column) -> Column:
    return ~d.rlike(r"^(\d)\1*$")


def cpf(c: Column) -> Column:
    d = digits(c)
    check = lambda s: F.when((s * 10) % 11 == 10, 0).otherwise((s * 10) % 11)
    one, two = check(_weighted(d, range(10, 1, -1))), check(_weighted(d, range(11, 1, -1)))
    return F.when(F.length(d) == 11, _varied(d) & (one == _digit(d, 10)) & (two == _digit(d, 11))).otherwise(False)


def cnpj(c: Column) -> Column:
    d = digits(c)
    check = lambda s: F.when(s % 11 < 2, 0).otherwise(11 - s % 11)
    w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    one, two = check(_weighted(d, w)), check(_weighted(d, [6, *w]))
    return F.when(F.length(d) == 14, _varied(d) & (one == _digit(d, 13)) & (two == _digit(d, 14))).otherwise(False)


def card(c: Column) -> Column:
    """Luhn on 13 to 19 digits."""
    d = digits(c)
    return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)


def cns(c: Column) -> Column:
    d = digits(c)
    return F.when((F.length(d) == 15) & d.rlike("^[12789]"), _weighted(d, range(15, 0, -1)) % 11 == 0).otherwise(False)


def ssn(c: Column) -> Column:
    d = digits(c)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return F.when(F.length(d) == 9, (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")).otherwise(False)


def iban(c: Column) -> Column:
    """Mod 97 of the letters as numbers, country and check digits last."""
    v = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    moved = F.concat(F.substring(v, 5, 100), F.substring(v, 1, 4))
    values = F.transform(F.split(moved, ""), lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)
    return F.when(v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.forall(parts, lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~p.startswith("0")))).otherwise(False)


def email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$") & ~c.contains("..") & ~c.startswith(".") & ~c.contains(".@") & ~c.contains("@."), F.lit(False))


def swift(c: Column) -> Column:
    """Letters of a bank, a country's code, two characters of a place and three of a branch or none; not one of the words that look like one."""
    code = F.upper(F.trim(c))
    return F.coalesce(code.rlike(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$") & F.substring(code, 5, 2).isin(list(swift_countries())) & ~code.isin(list(SWIFT_WORDS)), F.lit(False))


VALIDATORS = {"cpf": cpf, "cnpj": cnpj, "credit_card": card, "cns": cns, "ssn": ssn, "iban": iban, "ip_address": ipv4, "email": email, "swift_bic": swift}


# anonymisation of a value


def mask(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{L}\p{N}]", "*")


def salted(c: Column, kind: str, salt: str) -> Column:
    return F.concat(F.lit(kind.upper() + "_"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), c), 256), 1, 8))


def partial(c: Column, keep: int = 2) -> Column:
    """The first and last two letters or digits stay; of four and fewer none does."""
    each = F.split(c, "")
    marks = F.transform(each, lambda x: x.rlike(r"^[\p{L}\p{N}]$").cast("int"))
    total = F.aggregate(marks, F.lit(0), lambda a, x: a + x)
    # running position of each letter or digit among them
    walk = F.aggregate(
        F.arrays_zip(each.alias("x"), marks.alias("m")),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda a, e: F.struct(
            F.concat(a["out"], F.when((e["m"] == 1) & ((total <= 2 * keep) | ((a["n"] >= keep) & (a["n"] < total - keep))), "*").otherwise(e["x"])).alias("out"),
            (a["n"] + e["m"]).alias("n"),
        ),
    )
    return walk["out"]


def pseudonym(c: Column, pool: Sequence[str], seed: str) -> Column:
    """A value of the pool by the MD5 of seed and value, taken modulo its size digit by digit."""
    hexed = F.split(F.md5(F.concat(F.lit(seed + ":"), c).cast("binary")), "")
    rest = F.aggregate(F.transform(hexed, lambda x: F.conv(x, 16, 10).cast("int")), F.lit(0), lambda a, x: (a * 16 + x) % len(pool))
    return F.element_at(F.array(*map(F.lit, pool)), rest + 1)


# What stands in for names, addresses and numbers.
NAMES = ("João Silva", "Maria Santos", "Pedro Oliveira", "Ana Costa", "Carlos Souza", "Julia Lima", "Lucas Pereira", "Fernanda Alves", "John Doe", "Jane Smith", "Bob Johnson", "Alice Williams")
EMAILS = ("usuario1@exemplo.com", "contato@empresa.com", "info@dominio.com", "user@example.com", "contact@company.com", "hello@domain.com")
PHONES = ("(11) 9999-9999", "(21) 8888-8888", "(31) 7777-7777", "(555) 123-4567", "(555) 987-6543")


def stand_in(c: Column, entity: Column, seed: str) -> Column:
    """A value that stands in for c: of the pool for names, addresses and telephones; as many digits, 32 at most, for what begins with one; else PSEUDO_ and eight digits of the digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), c).cast("binary"))
    # a letter of the digest is the last digit of its code
    number = F.translate(F.substring(digest, F.lit(1), F.length(c)), "abcdef", "789012")
    pools = ((("person_name", "name"), NAMES), (("email",), EMAILS), (("phone", "phone_br", "phone_intl"), PHONES))
    out = F.when(c.rlike("^[0-9]"), number).otherwise(F.concat(F.lit("PSEUDO_"), F.substring(digest, 1, 8)))
    for kinds, pool in pools:
        out = F.when(entity.isin(list(kinds)), pseudonym(c, pool, seed)).otherwise(out)
    return out


def sealed(c: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(c, key))


def opened(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key).cast("string")


# Words that join parts of a name, first words and forms that no name has.
NAME_LINKS = ("de", "da", "do", "dos", "das", "e", "van", "von", "der", "del", "la", "el")
NOT_NAMES = (
    "erro", "token", "acesso", "usuario", "usuário", "cliente", "sistema",
    "cartao", "cartão", "pagamento", "autenticacao", "autenticação", "falha",
    "falhou", "portador", "titular", "conta", "senha", "login", "logout",
    "sessao", "sessão", "servico", "serviço", "endpoint", "api", "request",
    "response", "codigo", "código", "chave", "valor", "dados", "arquivo",
    "processo", "processamento", "transacao", "transação", "compra", "venda",
    "produto", "item", "pedido", "ordem", "status", "estado", "tipo",
    "critical", "error", "warning", "info", "debug", "fatal", "success",
    "failed", "failure", "exception", "message", "alert", "notice",
    "invalid", "valid", "null", "undefined", "unknown", "default",
    "system", "server", "client", "user", "admin", "root", "guest",
    "public", "private", "internal", "external", "local", "remote",
    "input", "output", "result", "return", "value", "data",
    "query", "update", "delete", "insert", "select", "create",
    "string", "integer", "float", "boolean", "array", "object",
    "true", "false", "function", "class", "method", "variable",
    "final", "inicial", "primeiro", "ultimo", "último", "novo", "antigo",
    "grande", "pequeno", "alto", "baixo", "bom", "mau", "melhor", "pior",
    "errou", "sucesso", "processou", "validou",
)
NOT_NAME_FORMS = (
    r"^erro\s", r"^error\s", r"^critical\s", r"^warning\s", r"^falha\s", r"^token\s", r"^cartao\s", r"^cartão\s",
    r"\s+(de|do|da)\s+(acesso|pagamento|autenticacao|autenticação|sistema|cliente|usuario|usuário)$",
    r"^(usuario|usuário)\s+\w+$", r"^(system|server|client|user)\s+\w+$",
)


def person_name(c: Column) -> Column:
    """Whether a text has the form of a person's name: two capitalised parts and more besides linking words, none of them all capitals, and no first
    word or form that names never have."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: ~F.lower(p).isin(list(NAME_LINKS)) & (p != ""))
    first = F.lower(F.get(parts, F.lit(0)))
    capital = F.forall(parts, lambda p: p.rlike(r"^\p{Lu}") & ~((F.upper(p) == p) & (F.length(p) > 2)))
    ok = (F.length(c) >= 5) & (F.size(parts) >= 2) & capital & ~first.isin(list(NOT_NAMES))
    for form in NOT_NAME_FORMS:
        ok = ok & ~F.lower(c).rlike(form)
    return F.coalesce(ok, F.lit(False))
