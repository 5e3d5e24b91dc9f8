"""Dictionaries of institutions, as (priority, tokens, found) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Companies, a line each; all words of a line must occur.
COMPANIES = """
ibm
yahoo
microsoft
twitter
walmart
thomson
wolfram
xerox
yandex
zynga
vtt
vmware
teradata
tencent
telefonica
texas instruments
thales
wellcome trust centre
telecom sudparis
telecom paristech
telecom italia
technicolor
tcl
taobao
t mobile
symantec
supelec
sorbonne
siemens
samsung
rakuten
qualcomm
philips
parc
nvidia
niksun
nikon
nicta
netflix
netapp
nec
narus
metz
lytro
linkedin
kxen
kaist
intel
inesc
imdea
huawei
google
fujitsu
general motors
facebook
exxonmobil
ebay
deloitte
delphi automotive
coverity
cloudera
centralesupelec
bosch
bell
bbn technologies
baidu
apple
arbor
amazon
alibaba
adobe
accenture
abb
cwi
hp
dell
sony
"""
#: Abbreviations and short forms of institutions, and their names.
SHORT_FORMS = """
mit: Massachusetts Institute of Technology
cmu: Carnegie Mellon University
stanford: Stanford University
uc berkeley: University of California Berkeley
ucla: University of California Los Angeles
ucsd: University of California San Diego
ucsb: University of California Santa Barbara
uci: University of California Irvine
uc santa cruz: University of California Santa Cruz
uc davis: University of California Davis
uc san diego: University of California San Diego
uiuc: University of Illinois at Urbana Champaign
stony brook: Stony Brook University
suny albany: University at Albany SUNY
rpi: Rensselaer Polytechnic Institute
princeton: princeton university
university california berkeley: University of California Berkeley
university california los angeles: University of California Los Angeles
university california san diego: University of California San Diego
university california santa barbara: University of California Santa Barbara
university california irvine: University of California Irvine
university california santa cruz: University of California Santa Cruz
university california davis: University of California Davis
university texas austin: University of Texas at Austin
ut austin: University of Texas at Austin
usc: university of southern california
umass: University of Massachusetts Amherst
iit: Indian Institute of Technology
rutgers: rutgers university
umich: university of michigan
ohsu: Oregon Health Science University
isti: Information Science and Technologies Institute
epfl: Swiss Federal Institute of Technology in Lausanne
unsw: University of New South Wales
inria: Inventors for the Digital World
hewlett packard: Hewlett Packard
los alamos national: Los Alamos National Laboratory
dso national: DSO National Laboratories
ntt communication: NTT Communications
ict: ict
irit: Institut de Recherche en Informatique de Toulouse
cselt: Centro Studi e Laboratori Telecomunicazioni
cea: French Alternative Energies and Atomic Energy Commission
"""
#: Names that are known by another one.
OTHER_NAMES = {"universidade federal do amazonas": "Federal University of Amazonas"}


def companies() -> list[tuple[list[str], str]]:
    return [(line.split(), line) for line in COMPANIES.strip().splitlines()]


def short_forms() -> list[tuple[list[str], str]]:
    return [(short.split(), name) for short, name in (line.split(": ") for line in SHORT_FORMS.strip().splitlines())]


def institutions(spark: SparkSession) -> DataFrame:
    """priority, tokens, found: companies first, then short forms."""
    rows = [(k, tokens, found) for k, (tokens, found) in enumerate(companies() + short_forms(), 1)]
    return spark.createDataFrame(rows, "priority int, tokens array<string>, found string")
