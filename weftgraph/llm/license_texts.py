"""Known licence sentences and ordered rules on them.

Fixed values: the sentences are those of the public licence texts. <> stands for any words (a holder's name); what comes
before | is what a sentence is known by, the rest may be missing or differ.
"""

TEXTS = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software| and associated documentation files (the Software), to deal in the Software without restriction",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies| or substantial portions of the Software",
    "mit_with": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction|",
    "as_is_any_kind": "The software is provided as is, without warranty of any kind|, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "as_is_by": "This software is provided by <> as is and| any express or implied warranties are disclaimed",
    "as_is_author": "The software is provided as is and the author disclaims all warranties| with regard to this software",
    "as_is": "<the|this> software is provided as is|",
    "no_liability": "In no event shall <> be liable for any| claim, damages or other liability",
    "no_liability_2": "In no event will <> be liable for any| damages",
    "x11_name": "Except as contained in this notice, the name of <> shall not be used in advertising or otherwise to promote the sale|, use or other dealings in this Software",
    "json_good": "The Software shall be used for Good, not Evil|",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that| the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that| the above copyright notice and this permission notice appear in all copies",
    "zero_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted|",
    "hpnd_grant": "Permission to use, copy, modify, <> this software and its documentation for any purpose <> is hereby granted|",
    "postgres_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted|, provided that the above copyright notice and this paragraph appear in all copies",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software| and accompanying documentation covered by this license",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met|",
    "bsd_source": "Redistributions of source code must retain the above copyright notice|, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice|, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_advert": "All advertising materials mentioning features or use of this software must display| the following acknowledgement",
    "bsd_endorse": "Neither the name of <> may be used to endorse or promote products| derived from this software without specific prior written permission",
    "bsd_endorse_2": "Neither the names of <> may be used to endorse or promote products| derived from this software without specific prior written permission",
    "bsd_endorse_3": "The name of the author may not be used to endorse or promote products| derived from this software without specific prior written permission",
    "openssl_any": "Redistributions of any form whatsoever must retain the following acknowledgment|",
    "apache_1_doc": "The end-user documentation included with the redistribution, if any, must include the following acknowledgment|",
    "apache_1_name": "Products derived from this software may not be called <>, nor may <> appear in their name|, without prior written permission",
    "apache_obey": "You may not use this <file|work|software> except in compliance with the License|",
    "apache_copy": "You may obtain a copy of the License at|",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis|, without warranties or conditions of any kind, either express or implied",
    "apache_copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license| to reproduce, prepare Derivative Works of the Work",
    "apache_patent": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license| to make, have made, use, offer to sell the Work",
    "gpl_2_title": "GNU General Public License Version 2, June 1991|",
    "gpl_3_title": "GNU General Public License Version 3, 29 June 2007|",
    "agpl_3_title": "GNU Affero General Public License Version 3, 19 November 2007|",
    "lgpl_21_title": "GNU Lesser General Public License Version 2.1, February 1999|",
    "lgpl_3_title": "GNU Lesser General Public License Version 3, 29 June 2007|",
    "gpl_freedom": "The licenses for most software are designed to take away your freedom to share and change it|",
    "gpl_freedom_3": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works|",
    "gpl_3_kind": "The GNU General Public License is a free, copyleft license for software and other kinds of works|",
    "agpl_3_kind": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works|, specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl_3_kind": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License|, supplemented by the additional permissions listed below",
    "lgpl_21_kind": "This license, the Lesser General Public License, applies to some specially designated software packages|",
    "gpl_hope": "<this program|this file|this library|this software|it> is distributed in the hope that it will be useful|, but without any warranty",
    "gpl_received": "You should have received a copy of the GNU <> License along with this <program|library|file|software>|",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at|",
    "mpl_11": "The contents of this file are subject to the Mozilla Public License Version 1.1|",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License|",
    "epl_1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0|",
    "epl_2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License <v2.0|v. 2.0|2.0|version 2.0>|",
    "unlicense": "This is free and unencumbered software released into the public domain|",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software|, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0_deed": "The person who associated a work with this deed has dedicated the work to the public domain|",
    "cc0_fallback": "To the extent possible under law, <> has waived all copyright and related or neighboring rights to|",
    "zlib_as_is": "This software is provided as-is, without any express or implied warranty|",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose|, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib_origin": "The origin of this software must not be misrepresented|; you must not claim that you wrote the original software",
    "zlib_altered": "Altered source versions must be plainly marked as such|, and must not be misrepresented as being the original software",
    "zlib_notice": "This notice may not be removed or altered from any source distribution|",
    "wtfpl_copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed|",
    "python_grant": "Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license|",
    "artistic_2": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed|",
    "eupl": "Licensed under the EUPL, Version 1.2|",
    "ms_pl": "This license governs use of the accompanying software|",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1|",
    "blue_oak": "Each contributor licenses you to do everything with this software that would otherwise infringe that contributor's copyright in it|",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff|",
    "sspl": "If you make the functionality of the Program or a modified version available to third parties as a service|, you must make the Service Source Code available via network download to everyone at no charge",
    "elastic_2": "You may not provide the software to third parties as a hosted or managed service|",
    "busl": "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work|",
}

# Notices that name a licence, as patterns on normalised text from its start; a group v is the licence's version, "later"
# adds a plus. Each may go on over wrapped lines.
_WORK = r"(?:(?:this|the) (?:work|program|file|software|project|package|library|code|source code|document|text|content|material|library|module) (?:is|are) )?(?:(?:licensed|released|available|distributed|published|provided) )(?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:a )?"
_VERSION = r"(?:version )?(?:v ?)?(?P<v>\d(?:\.\d)?)"
_LATER = r"(?P<later> or (?:at your option )?(?:any )?later)?"
NOTICES = [
    ("spdx", r"spdx-license-identifier (?P<v>[a-z0-9.+-]+)"),
    ("agpl_name", rf"{_WORK}(?:gnu )?(?:affero general public license|agpl)(?: agpl)? ?(?:{_VERSION})?{_LATER}"),
    ("lgpl_name", rf"{_WORK}(?:gnu )?(?:lesser|library) general public license ?(?:{_VERSION})?{_LATER}"),
    ("gpl_name", rf"{_WORK}(?:gnu )?(?:general public license|gpl)(?: gpl)? ?(?:{_VERSION})?{_LATER}"),
    ("apache_name", rf"{_WORK}apache (?:software )?license ?(?:{_VERSION})?"),
    ("mit_name", rf"{_WORK}(?:the )?mit(?: open source)? license"),
    ("isc_name", rf"{_WORK}isc license"),
    ("bsl_name", rf"{_WORK}boost software license ?(?:{_VERSION})?"),
    ("bsd_name", rf"{_WORK}(?P<v>[234])[- ]clause bsd license|{_WORK}bsd (?P<v2>[234])[- ]clause license"),
    ("bsd_any", rf"{_WORK}(?:new |modified |simplified )?bsd(?:-style)? license"),
    ("mpl_name", rf"(?:{_WORK}|this source code form is subject to the terms of the )mozilla public license ?(?:v\. ?)?(?:{_VERSION})?"),
    ("cc0_name", rf"{_WORK}(?:creative commons )?(?:cc0|cc zero)"),
    ("cc_name", rf"{_WORK}(?:creative commons|cc)[ -](?P<kind>by(?:-(?:nc|sa|nd))*|attribution(?:-(?:noncommercial|sharealike|noderivatives|noderivs))*) ?(?:license |international )?(?:{_VERSION})?"),
    ("public_domain", r"(?:this (?:work|file|code|software|program) is |released |placed |dedicated )(?:in|into|to) the public domain"),
    ("gpl_free", r"this (?:program|file|library|software) is free software(?: you can redistribute it and/or modify it under the terms of the gnu (?P<kind>affero |lesser |library )?general public license.*?(?:version (?P<v>\d(?:\.\d)?))(?P<later>.*?any later version)?)?"),
    ("gpl_terms", r"you can redistribute it and/or modify it under the terms of the gnu (?P<kind>affero |lesser |library )?general public license(?:.*?(?:version (?P<v>\d(?:\.\d)?))(?P<later>(?: of the license)? or (?:at your option )?any later version)?)?"),
    ("gpl_either", r"either version (?P<v>\d(?:\.\d)?) of the license or (?:at your option )?(?P<later>any later version)"),
    ("reserved", r"(?:copyright .*?)?all rights reserved"),
    ("copyright", r"(?:copyright|©|c) (?:c |© )?.*?\d{4}"),
]
#: Notices of one line only.
ONE_LINE = {"reserved", "copyright"}

# Ordered rules on sequences of identifiers: the licence's name with {v} for the version, and a pattern whose words are
# identifiers; ? marks one that may be missing, / one of several, * any number of one or several. Copyright lines are passed over beforehand.
_END = "as_is_any_kind/as_is_by/as_is_author/as_is? no_liability/no_liability_2?"
RULES = [
    ("{v}", "spdx"),
    ("OpenSSL", "bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse/bsd_endorse_2/bsd_endorse_3? openssl_any"),
    ("Apache-1.1", f"bsd_grant bsd_source bsd_binary apache_1_doc bsd_endorse/bsd_endorse_2/bsd_endorse_3? apache_1_name? {_END}"),
    ("BSD-4-Clause", f"bsd_grant bsd_source bsd_binary bsd_advert bsd_endorse/bsd_endorse_2/bsd_endorse_3? {_END}"),
    ("BSD-3-Clause", f"bsd_grant bsd_source bsd_binary bsd_endorse/bsd_endorse_2/bsd_endorse_3 {_END}"),
    ("BSD-2-Clause", f"bsd_grant bsd_source bsd_binary {_END}"),
    ("BSD-1-Clause", f"bsd_grant bsd_source {_END}"),
    ("NCSA", f"mit_with bsd_source bsd_binary bsd_endorse/bsd_endorse_2/bsd_endorse_3? {_END}"),
    ("JSON", f"mit_name? mit_grant mit_notice json_good {_END}"),
    ("X11", f"mit_grant mit_notice {_END} x11_name"),
    ("MIT", f"mit_name? mit_grant mit_notice {_END}"),
    ("MIT-0", f"mit_grant {_END}"),
    ("BSL-1.0", f"bsl_name? bsl_grant {_END}"),
    ("ISC", f"isc_grant/isc_grant_and {_END}"),
    ("0BSD", f"zero_grant {_END}"),
    ("PostgreSQL", f"postgres_grant {_END}"),
    ("HPND", f"hpnd_grant {_END}"),
    ("MIT", "mit_name"),
    ("ISC", "isc_name"),
    ("BSL-{v}", "bsl_name"),
    ("Apache-{v}", "apache_name apache_obey? apache_copy? apache_basis?"),
    ("Apache-2.0", "apache_copyright apache_patent"),
    ("AGPL-{v}", "agpl_name gpl_hope? gpl_received?"),
    ("LGPL-{v}", "lgpl_name gpl_hope? gpl_received?"),
    ("GPL-{v}", "gpl_name gpl_hope? gpl_received?"),
    ("{kind}GPL-{v}", "gpl_free? gpl_terms gpl_either? gpl_hope? gpl_received?"),
    ("{kind}GPL-{v}", "gpl_free gpl_either? gpl_hope? gpl_received?"),
    ("AGPL-3.0", "agpl_3_title agpl_3_kind? gpl_freedom_3?"),
    ("LGPL-3.0", "lgpl_3_title lgpl_3_kind?"),
    ("LGPL-2.1", "lgpl_21_title gpl_freedom? lgpl_21_kind?"),
    ("GPL-3.0", "gpl_3_title gpl_3_kind? gpl_freedom_3?"),
    ("GPL-2.0", "gpl_2_title gpl_freedom?"),
    ("AGPL-3.0", "agpl_3_kind gpl_freedom_3?"),
    ("LGPL-3.0", "lgpl_3_kind"),
    ("LGPL-2.1", "lgpl_21_kind"),
    ("GPL-3.0", "gpl_3_kind gpl_freedom_3?"),
    ("MPL-{v}", "mpl_name mpl_copy?"),
    ("MPL-1.1", "mpl_11 apache_obey? apache_copy?"),
    ("CDDL-1.0", "cddl apache_obey? apache_copy?"),
    ("EPL-1.0", "epl_1"),
    ("EPL-2.0", "epl_2"),
    ("CC0-1.0", "cc0_name cc0_deed? cc0_fallback?"),
    ("CC0-1.0", "cc0_deed"),
    ("CC0-1.0", "cc0_fallback"),
    ("CC-{kind}-{v}", "cc_name"),
    ("Unlicense", f"unlicense unlicense_anyone? {_END}"),
    ("Zlib", "zlib_as_is no_liability/no_liability_2? zlib_grant zlib_origin? zlib_altered? zlib_notice?"),
    ("Zlib", "zlib_grant zlib_origin zlib_altered zlib_notice?"),
    ("WTFPL", "wtfpl_copy"),
    ("Python-2.0", "python_grant"),
    ("Artistic-2.0", "artistic_2"),
    ("EUPL-1.2", "eupl"),
    ("MS-PL", "ms_pl"),
    ("OFL-1.1", "ofl"),
    ("BlueOak-1.0.0", "blue_oak"),
    ("Beerware", "beerware"),
    ("SSPL-1.0", "sspl"),
    ("Elastic-2.0", "elastic_2"),
    ("BUSL-1.1", "busl"),
    ("BSD-{v}-Clause", f"bsd_name {_END}"),
    ("BSD", f"bsd_any {_END}"),
    ("Public-Domain", "public_domain"),
    ("All-Rights-Reserved", "reserved"),
]
