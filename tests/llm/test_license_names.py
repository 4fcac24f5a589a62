"""Identifiers of the public list of licences, and names that count only after the words a licence is spoken of with."""

import pytest

from panelspark.llm import license_scan

IDS = {
    "MIT": "mit", "ISC": "isc", "MIT-0": "mit-0", "Apache-2.0": "apache-2", "Apache-1.1": "apache-1.1", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause", "0BSD": "0bsd",
    "GPL-2.0-only": "gpl-2", "GPL-2.0-or-later": "gpl-2", "GPL-3.0-only": "gpl-3", "LGPL-2.1-only": "lgpl-2.1", "LGPL-3.0-only": "lgpl-3", "AGPL-3.0-only": "agpl-3", "GFDL-1.3-only": "gfdl-1.3", "MPL-2.0": "mpl-2", "MPL-1.1": "mpl-1.1",
    "EPL-2.0": "epl-2", "EPL-1.0": "epl-1", "CDDL-1.0": "cddl-1", "CDDL-1.1": "cddl-1.1", "EUPL-1.2": "eupl-1.2", "Artistic-2.0": "artistic-2", "Artistic-1.0": "artistic-1", "BSL-1.0": "boost-1", "Zlib": "zlib", "libpng-2.0": "libpng",
    "Unlicense": "unlicense", "WTFPL": "wtfpl", "PostgreSQL": "postgresql", "Python-2.0": "python-2", "PSF-2.0": "python-2", "Ruby": "ruby", "PHP-3.01": "php-3", "TCL": "tcl", "curl": "curl", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "SSPL-1.0": "sspl-1",
    "Elastic-2.0": "elastic-2", "BUSL-1.1": "busl-1.1", "OFL-1.1": "ofl-1.1", "ODbL-1.0": "odbl-1", "ODC-By-1.0": "odc-by-1", "PDDL-1.0": "pddl-1", "CDLA-Permissive-2.0": "cdla-permissive-2", "CDLA-Permissive-1.0": "cdla-permissive-1",
    "OGL-UK-3.0": "ogl-uk-3", "etalab-2.0": "etalab-2", "Vim": "vim", "X11": "x11", "HPND": "hpnd", "NCSA": "ncsa", "OpenSSL": "openssl", "ECL-2.0": "ecl-2", "OSL-3.0": "osl-3", "AFL-3.0": "afl-3", "UPL-1.0": "upl-1", "MulanPSL-2.0": "mulan-2",
    "CECILL-2.1": "cecill-2.1", "CECILL-B": "cecill-b", "CC0-1.0": "cc0-1", "CC-BY-4.0": "cc-by-4", "CC-BY-SA-4.0": "cc-by-sa-4", "CC-BY-NC-ND-3.0": "cc-by-nc-nd-3", "Sleepycat": "sleepycat", "SPL-1.0": "spl-1", "QPL-1.0": "qpl-1", "NPL-1.1": "npl-1.1",
    "RPL-1.5": "rpl-1.5", "Watcom-1.0": "watcom-1", "LPPL-1.3c": None, "ImageMagick": "imagemagick", "IJG": "ijg", "Unicode-3.0": "unicode-3", "BlueOak-1.0.0": "blueoak-1", "JSON": "json", "Beerware": "beerware", "IPL-1.0": "ipl-1", "CPL-1.0": "cpl-1",
    "CPAL-1.0": "cpal-1", "DL-DE-BY-2.0": "dl-de-by-2",
}
SAID = ("SPDX-License-Identifier: {}", "x = 1\n# License: {}\n", "Licensed under {}.", "It is released under the terms of the {} and more.", "available under {}, as is")


@pytest.fixture(scope="module")
def found(spark):
    texts = [(f"{k}|{i}", form.format(k)) for k in IDS for i, form in enumerate(SAID)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    return {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(docs).collect()}


@pytest.mark.parametrize("name", [k for k, v in IDS.items() if v])
def test_identifiers(found, name):
    got = [found[f"{name}|{i}"] for i in range(len(SAID))]
    assert all(IDS[name] in labels - {"cc-by-nc"} | ({IDS[name]} & labels) for labels in got), got


def test_names_without_a_form_are_no_licence(spark):
    texts = ["She studied at MIT in Boston.", "ruby and json, curl and vim", "a permit by the mitre", "the isc2 and x11r6", "under the mitigation plan", "the apache helicopter", "of python 3 snakes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts)) if got[i]] == [], got
