"""Fixed values of the survey domain.

Everything here is a constant that must equal the published data (column
names, codes, labels, tokens).  Operators take columns as arguments; these are
only their defaults.
"""

from __future__ import annotations

YEAR = "NU_ANO_CENSO"
UNIT = "CO_ENTIDADE"
UF = "SG_UF"
STATUS = "TP_SITUACAO_FUNCIONAMENTO"
ACTIVE = 1
ENROLMENTS = "QT_MAT_BAS"
TEACHERS = "QT_DOC_BAS"
MUNICIPALITY_KEYS = ("SG_UF", "CO_MUNICIPIO", "NO_MUNICIPIO")

# Default column sets of an edition.
BASIC_COLUMNS = (
    "NU_ANO_CENSO", "CO_ENTIDADE", "NO_ENTIDADE", "CO_UF", "SG_UF", "CO_MUNICIPIO",
    "NO_MUNICIPIO", "TP_DEPENDENCIA", "TP_LOCALIZACAO", "TP_SITUACAO_FUNCIONAMENTO",
)
INFRA_COLUMNS = (
    "IN_AGUA_POTAVEL", "IN_ENERGIA_REDE_PUBLICA", "IN_ESGOTO_REDE_PUBLICA", "IN_BIBLIOTECA",
    "IN_LABORATORIO_INFORMATICA", "IN_LABORATORIO_CIENCIAS", "IN_QUADRA_ESPORTES",
    "IN_REFEITORIO", "IN_INTERNET", "IN_BANDA_LARGA", "IN_ACESSIBILIDADE_RAMPAS",
)
COUNT_COLUMNS = (
    "QT_MAT_BAS", "QT_MAT_INF", "QT_MAT_FUND", "QT_MAT_MED", "QT_MAT_EJA", "QT_MAT_ESP",
    "QT_DOC_BAS", "QT_TUR_BAS", "QT_SALAS_UTILIZADAS",
)

# Code -> label, per coded column.
CODE_LABELS: dict[str, dict[int, str]] = {
    "TP_DEPENDENCIA": {1: "Federal", 2: "Estadual", 3: "Municipal", 4: "Privada"},
    "TP_LOCALIZACAO": {1: "Urbana", 2: "Rural"},
    "TP_LOCALIZACAO_DIFERENCIADA": {
        0: "Não está em área diferenciada",
        1: "Área de assentamento",
        2: "Terra indígena",
        3: "Área remanescente de quilombos",
        7: "Área de assentamento",
        8: "Terra indígena",
    },
    "TP_SITUACAO_FUNCIONAMENTO": {
        1: "Em atividade",
        2: "Paralisada",
        3: "Extinta (ano do censo)",
        4: "Extinta em anos anteriores",
    },
    "TP_CATEGORIA_ESCOLA_PRIVADA": {
        1: "Particular", 2: "Comunitária", 3: "Confessional", 4: "Filantrópica",
    },
}

# State acronym -> (code, name, region).
STATES: dict[str, tuple[int, str, str]] = {
    "RO": (11, "Rondônia", "Norte"),
    "AC": (12, "Acre", "Norte"),
    "AM": (13, "Amazonas", "Norte"),
    "RR": (14, "Roraima", "Norte"),
    "PA": (15, "Pará", "Norte"),
    "AP": (16, "Amapá", "Norte"),
    "TO": (17, "Tocantins", "Norte"),
    "MA": (21, "Maranhão", "Nordeste"),
    "PI": (22, "Piauí", "Nordeste"),
    "CE": (23, "Ceará", "Nordeste"),
    "RN": (24, "Rio Grande do Norte", "Nordeste"),
    "PB": (25, "Paraíba", "Nordeste"),
    "PE": (26, "Pernambuco", "Nordeste"),
    "AL": (27, "Alagoas", "Nordeste"),
    "SE": (28, "Sergipe", "Nordeste"),
    "BA": (29, "Bahia", "Nordeste"),
    "MG": (31, "Minas Gerais", "Sudeste"),
    "ES": (32, "Espírito Santo", "Sudeste"),
    "RJ": (33, "Rio de Janeiro", "Sudeste"),
    "SP": (35, "São Paulo", "Sudeste"),
    "PR": (41, "Paraná", "Sul"),
    "SC": (42, "Santa Catarina", "Sul"),
    "RS": (43, "Rio Grande do Sul", "Sul"),
    "MS": (50, "Mato Grosso do Sul", "Centro-Oeste"),
    "MT": (51, "Mato Grosso", "Centro-Oeste"),
    "GO": (52, "Goiás", "Centro-Oeste"),
    "DF": (53, "Distrito Federal", "Centro-Oeste"),
}

# What each three-character name prefix says a variable is.
KIND_BY_PREFIX = {
    "NU_": "número",
    "CO_": "código",
    "NO_": "nome",
    "SG_": "sigla",
    "DS_": "descrição",
    "TP_": "categórica codificada",
    "IN_": "indicador (0/1)",
    "QT_": "contagem",
    "DT_": "data",
    "TX_": "texto livre",
}

# Type declared by each prefix, and codes that are text by name.
TYPE_BY_PREFIX = {
    "IN_": "Int8",
    "TP_": "Int8",
    "QT_": "Int32",
    "CO_": "Int64",
    "NO_": "string",
    "SG_": "string",
    "DS_": "string",
}
TEXT_CODES = ("CO_ORGAO_REGIONAL",)

# Type lattice from narrowest to widest, its Spark types, and the
# marker of a column without any value (outside the lattice).
LATTICE = ("Int8", "Int16", "Int32", "Int64", "Float64", "string")
SPARK_TYPE = {
    "Int8": "tinyint",
    "Int16": "smallint",
    "Int32": "int",
    "Int64": "bigint",
    "Float64": "double",
    "string": "string",
}
EMPTY = "vazio"

# Tokens that mean "no value" in the text editions.
NA_TOKENS = (
    "", "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "<NA>", "NULL", "null", "None",
    "NaN", "nan", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Distinct values counted exactly per column, examples shown.
DISTINCT_CAP = 200
EXAMPLES = 5

# File names of the entity table, matched case-insensitively.
EDITION_FILE_PATTERNS = (
    r"microdados_ed_basica_\d{4}\.csv",
    r"Tabela_Escola_\d{4}(_V\d+)?\.csv",
    r"escolas\.csv",
)

# Dialect of the edition files.
SEPARATOR = ";"
ENCODING = "ISO-8859-1"

# Description sheet field -> how its header label starts.
SHEET_LABELS = {
    "coluna": "nome da vari",
    "descricao": "descri",
    "tipo_inep": "tipo",
    "tamanho_inep": "tam",
    "categorias": "categoria",
}
# Which sheet of a workbook describes the entity table, in order
# of preference, and which one never does.
SHEET_PREFERENCE = ("escola", "cadastro", "unidade_coleta")
SHEET_EXCLUDED = "gestor"

# Mesh level -> grouping column, grouping column -> name column,
# mesh scope -> row filter column.
LEVELS = {
    "uf": "CO_UF",
    "regiao-intermediaria": "CO_REGIAO_GEOG_INTERM",
    "mesorregiao": "CO_MESORREGIAO",
    "regiao-imediata": "CO_REGIAO_GEOG_IMED",
    "microrregiao": "CO_MICRORREGIAO",
    "municipio": "CO_MUNICIPIO",
}
AREA_NAME = {
    "CO_UF": "NO_UF",
    "CO_REGIAO_GEOG_INTERM": "NO_REGIAO_GEOG_INTERM",
    "CO_MESORREGIAO": "NO_MESORREGIAO",
    "CO_REGIAO_GEOG_IMED": "NO_REGIAO_GEOG_IMED",
    "CO_MICRORREGIAO": "NO_MICRORREGIAO",
    "CO_MUNICIPIO": "NO_MUNICIPIO",
}
SCOPE_FILTER = {"estados": "CO_UF", "municipios": "CO_MUNICIPIO"}
MESH_HOST = "servicodados.ibge.gov.br"
MESH_FORMAT = "application/vnd.geo+json"

# Colour classes of a map, codes listed in the coverage report.
COLOUR_CLASSES = 7
LISTED_CODES = 20

# Fixed value: a map file larger than this is worth a warning.
MAP_BYTES = 1_500_000
