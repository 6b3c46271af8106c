"""Word tables of the normalizers. All tables here are fixed values; each line gives a form and the spellings it stands for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def table(text: str, sep: str = ",") -> dict[str, str]:
    """Spelling to form, from lines of ``form: spellings``."""
    lines = (line.split(":") for line in text.strip().splitlines())
    return {s.strip(): form.strip() for form, spellings in lines for s in spellings.split(sep) if s.strip()}


# Legal forms everywhere.
LEGAL = table("""
pvt: pvt, private, praivet, piraivet, praibhet, praivrr
ltd: ltd, limited, limitet, limirrd
llc: llc
pllc: pllc
llp: llp, elelpi
lp: lp
inc: inc, incorporated
corp: corp, corporation
co: co, company
pc: pc
opc: opc
""")
# Legal forms of France.
LEGAL_FRANCE = table("""
sarl: sarl
sas: sas
sasu: sasu
sci: sci
eurl: eurl
sa: sa
ei: ei
snc: snc
selarl: selarl
scop: scop
gie: gie
co: cie, compagnie
""")
# Words in names.
NAME_WORDS = table("saint: st")
NAME_WORDS_FRANCE = table("and: et\netablissements: ets")
# Words in addresses.
STREETS = table("""
road: rd
avenue: ave, av
drive: dr
lane: ln
court: ct
place: pl
circle: cir
boulevard: blvd, bd
highway: hwy
parkway: pkwy
terrace: ter
trail: trl
square: sq
floor: fl, flr
building: bldg
apartment: apt
apartments: apts
opposite: opp
near: nr
district: dist
""")
STREETS_FRANCE = table("""
rue: r
allee: all
impasse: imp
chemin: chem
route: rte
faubourg: fg
cours: crs
quai: qu
""")
STREETS_INDIA = table("""
mumbai: bombay
kolkata: calcutta
chennai: madras
bengaluru: bangalore
pune: poona
gurugram: gurgaon
kochi: cochin
kozhikode: calicut
thiruvananthapuram: trivandrum
ahmednagar: ahilyanagar
prayagraj: allahabad
mysuru: mysore
belagavi: belgaum
vadodara: baroda
ahmedabad: ahmadabad
visakhapatnam: vishakhapatnam
sonipat: sonepat
kanchipuram: kancheepuram
malappuram: malapuram
tiruvallur: thiruvallur
new delhi: newdelhi
""")
# Words left out of addresses; words after which "st" is a street; kinds of settlement; what stands for nothing.
DROPPED = ("unit", "suite", "city")
AFTER_STREET = ("n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west", "apt", "apartment", "unit", "suite", "ste", "fl", "floor", "flr", "bldg")
SETTLEMENTS = ("city", "town", "village")
NULL_PARTS = ("null", "na", "n a", "none")
# States of the United States, of India (also as transliterated), regions of France with their departments.
STATES = table("""
al: alabama
ak: alaska
az: arizona
ar: arkansas
ca: california
co: colorado
ct: connecticut
de: delaware
dc: district of columbia
fl: florida
ga: georgia, goa
hi: hawaii
id: idaho
il: illinois
in: indiana
ia: iowa
ks: kansas
ky: kentucky
la: louisiana
me: maine
md: maryland
ma: massachusetts
mi: michigan
mn: minnesota
ms: mississippi
mo: missouri
mt: montana
ne: nebraska
nv: nevada
nh: new hampshire
nj: new jersey
nm: new mexico
ny: new york
nc: north carolina
nd: north dakota
oh: ohio
ok: oklahoma
or: oregon
pa: pennsylvania
ri: rhode island
sc: south carolina
sd: south dakota
tn: tennessee, tamil nadu, tmilnatu
tx: texas
ut: utah
vt: vermont
va: virginia
wa: washington
wv: west virginia
wi: wisconsin
wy: wyoming
mh: maharashtra, mharastr
dl: delhi, dilli
up: uttar pradesh, uttr prdes
ka: karnataka, krnatk
gj: gujarat, gujrat
wb: west bengal, pscimbng
tg: telangana, telmgan
hr: haryana, hriyana
rj: rajasthan, rajsthan
kl: kerala, keralam, kerlm
br: bihar
mp: madhya pradesh, mdhy prdes
ap: andhra pradesh, amdhrprdes
pb: punjab, pmjab
od: odisha, orissa, od isa
as: assam
jh: jharkhand
cg: chhattisgarh
uk: uttarakhand
hp: himachal pradesh
jk: jammu and kashmir
py: puducherry
ch: chandigarh
hdf: hauts de france, nord, pas de calais, aisne, oise, somme
naq: nouvelle aquitaine, gironde, charente, charente maritime, correze, creuse, dordogne, landes, lot et garonne, pyrenees atlantiques, deux sevres, vienne, haute vienne
pdl: pays de la loire, loire atlantique, maine et loire, mayenne, sarthe, vendee
""")
STATE_CODES = tuple(sorted(set(STATES.values())))


def literal_map(d: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values())))


def by_country(country: Column, general: dict[str, str], **special: dict[str, str]) -> Column:
    """The table that holds in a row's country."""
    return reduce(lambda rest, kv: F.when(country == kv[0], literal_map(general | kv[1])).otherwise(rest), special.items(), literal_map(general))
