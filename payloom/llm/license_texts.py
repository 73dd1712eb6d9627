"""Signatures of license texts: sentences that licenses, notices and their headers are known by, as words in lower case.

Label, expression over words, keyword that a text must hold, priority. Where two licenses share a sentence, the label is
that of the family. Fixed values.
"""

TEXTS = (
    # MIT and its kin
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 90),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial portions", 72),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", "the software is provided", 62),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "in no event shall the authors", 62),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "permission is hereby", 96),
    ("mit-advertising", r"all advertising materials .{0,60}mit license", "advertising materials", 66),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium", 93),
    ("x11", r"x window system is a trademark of x consortium", "x window system", 92),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission is hereby", 91),
    ("bsl-1.0", r"distributed under the boost software license", "boost software", 86),
    ("bsl-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code", "machine executable object code", 88),
    ("ncsa", r"redistributions of source code must retain .{0,80}neither the names of .{0,60}university of illinois", "university of illinois", 91),
    ("json", r"the software shall be used for good not evil", "good not evil", 95),
    # ISC and permissive one-paragraph notices
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 90),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims all warranties", 74),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "permission to use", 94),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "permission to use", 91),
    ("hpnd", r"and that the name of .{0,60}not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "publicity pertaining", 75),
    ("ntp", r"this software is provided as is without express or implied warranty", "without express or implied", 58),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use", 93),
    ("curl", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote", "name of a copyright holder", 90),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software", "authors hereby grant", 90),
    ("afmparse", r"this file and the .{0,30}postscript .{0,12}afm files it accompanies may be used copied and distributed for any purpose", "afm files", 90),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "medium without royalty", 90),
    ("fsful", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", "unlimited permission", 91),
    ("fsfullr", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved", "unlimited permission", 91),
    # BSD
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 85),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source", 72),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 72),
    ("bsd", r"this software is provided by the (?:regents|copyright holders?)(?: and contributors)? as is and any express or implied warranties", "this software is provided by", 70),
    ("bsd-3-clause", r"neither the name of .{0,80}nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote", 88),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "patent rights are granted", 91),
    ("bsd-3-clause-no-nuclear", r"(?:is )?not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear facility", 92),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials", 89),
    ("bsd-4-clause-uc", r"this product includes software developed by the university of california berkeley and its contributors", "university of california", 93),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive", "hereby grants to those", 91),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided", "redistributions of source", 92),
    ("bsd-source-code", r"use of .{0,40}in any form must retain the original copyright notice", "original copyright notice", 64),
    # Apache
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", "except in compliance", 84),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable law", 84),
    ("apache-2.0", r"without warranties or conditions of any kind either express or implied", "warranties or conditions", 68),
    ("apache-2.0", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants", "grant of copyright", 88),
    ("apache-2.0", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", "grant of patent", 88),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation", 80),
    ("apache-1.1", r"the names apache and apache software foundation must not be used to endorse or promote products", "must not be used to endorse", 91),
    ("apache-1.0", r"this product includes software developed by the apache group for use in the apache http server project", "apache group", 92),
    ("ecl-2.0", r"licensed under the educational community license version 2 0", "educational community", 92),
    # GNU
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "you can redistribute", 88),
    ("gpl-2.0", r"gnu general public licen[cs]e as published by the free software foundation either version 2", "free software foundation", 91),
    ("gpl-3.0", r"gnu general public licen[cs]e as published by the free software foundation either version 3", "free software foundation", 91),
    ("gpl-1.0", r"gnu general public licen[cs]e as published by the free software foundation either version 1", "free software foundation", 91),
    ("gpl-2.0-only", r"under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation", "free software foundation", 92),
    ("gpl-3.0-only", r"under the terms of the gnu general public licen[cs]e version 3 as published by the free software foundation", "free software foundation", 92),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with this program", "you should have received", 78),
    ("gpl", r"see the gnu general public licen[cs]e for more details", "for more details", 76),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public", "implied warranty of", 74),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "freedom to share", 90),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft", 93),
    ("gpl-2.0", r"we protect your rights with two steps 1 copyright the software and 2 offer you this license", "protect your rights", 92),
    ("gpl-exception-classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "linking this library", 93),
    ("gpl-exception-gcc", r"gcc runtime library exception", "runtime library exception", 90),
    ("gpl-exception-autoconf", r"as a special exception .{0,80}configuration script generated by autoconf", "generated by autoconf", 91),
    ("gpl-exception-bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 93),
    ("gpl-exception-font", r"if you create a document which uses this font and embed this font or unaltered portions", "embed this font", 91),
    ("gpl-exception-linking", r"as a special exception .{0,60}permission to link", "permission to link", 70),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "you can redistribute", 89),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1", "lesser general", 93),
    ("lgpl-3.0", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3", "lesser general", 93),
    ("lgpl-2.0", r"gnu library general public licen[cs]e as published by the free software foundation either version 2", "library general", 93),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e", "lesser general", 79),
    ("lgpl", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "work with the library", 88),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "affero", 90),
    ("agpl-3.0", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3", "affero", 94),
    ("agpl-3.0", r"remote network interaction use with the gnu general public license", "remote network interaction", 91),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "free documentation", 90),
    ("gfdl-1.3", r"gnu free documentation licen[cs]e version 1 3 or any later version published by the free software foundation", "free documentation", 93),
    ("gfdl-1.2", r"gnu free documentation licen[cs]e version 1 2 or any later version published by the free software foundation", "free documentation", 93),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant sections", 84),
    # Mozilla, Eclipse, CDDL and others with a file-wise copyleft
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "source code form", 92),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 90),
    ("mpl-2.0-no-copyleft-exception", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", "secondary licenses", 94),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla public", 92),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 0", "mozilla public", 92),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu general public license", "contents of this file", 80),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license version 1 1", "netscape public", 92),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", "accompanying materials", 92),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", "accompanying materials", 92),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses when the conditions", "following secondary licenses", 88),
    ("cpl-1.0", r"this program and the accompanying materials are made available under the terms of the common public license", "accompanying materials", 91),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "common development", 90),
    ("cddl-1.1", r"either the gnu general public license version 2 only gpl or the common development and distribution license", "common development", 92),
    ("apsl-2.0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", "apple public source", 92),
    ("cecill", r"this software is governed by the cecill(?: [bc])? license under french law", "cecill", 92),
    ("eupl-1.2", r"licensed under the eupl version 1 2", "eupl", 92),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "accompanying software", 89),
    ("osl-3.0", r"licensed under the open software license version 3 0", "open software licen", 92),
    ("afl-3.0", r"licensed under the academic free license version 3 0", "academic free", 92),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "free software package", 91),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "conditions under which a package", 91),
    ("artistic-perl", r"under the same terms as perl itself", "as perl itself", 86),
    # Public domain and near it
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 90),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 88),
    ("cc0-1.0", r"to the extent possible under law .{0,80}waived all copyright and related or neighboring rights", "neighboring rights", 92),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "with this deed", 92),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 60),
    ("public-domain", r"this (?:file|work|software|code|document) is in the public domain", "public domain", 62),
    ("public-domain", r"no copyright is claimed", "no copyright is claimed", 55),
    ("wtfpl-2.0", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim or modified", 90),
    ("wtfpl-2.0", r"you just do what the fuck you want to", "what the fuck", 88),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer", 92),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable", 88),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions", 90),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented", 80),
    ("libpng", r"this copy of the libpng notices is provided for your convenience", "libpng notices", 92),
    ("sqlite-blessing", r"may you do good and not evil may you find forgiveness for yourself and forgive others", "forgive others", 95),
    # Creative Commons, data and fonts
    ("cc-by", r"this work is licensed under a creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)? licen[cs]e", "creative commons attribution", 82),
    ("cc-by-sa", r"this work is licensed under a creative commons attribution share ?alike", "creative commons attribution", 84),
    ("cc-by-nc", r"this work is licensed under a creative commons attribution non ?commercial", "creative commons attribution", 83),
    ("cc-by-nd", r"this work is licensed under a creative commons attribution no ?deriv", "creative commons attribution", 83),
    ("cc", r"creativecommons org licenses", "creativecommons org", 45),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons org", 90),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format", "redistribute the material", 66),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "font software", 93),
    ("ofl-1.1", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "font software", 92),
    ("odbl-1.0", r"this .{0,40}is made available under the open database license", "open database", 90),
    ("odc-by-1.0", r"made available under the open data commons attribution license", "data commons attribution", 91),
    ("pddl-1.0", r"made available under the public domain dedication and license", "domain dedication", 91),
    ("ubuntu-font-1.0", r"ubuntu font licen[cs]e", "ubuntu font", 88),
    ("bitstream-vera", r"bitstream vera is a trademark of bitstream", "bitstream vera", 90),
    # Languages and projects
    ("psf-2.0", r"this license agreement is between the python software foundation", "python software foundation", 92),
    ("python", r"python is copyright .{0,40}by stichting mathematisch centrum", "stichting mathematisch", 91),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "verbatim copies of the source", 90),
    ("php-3.01", r"this product includes php software freely available from", "php software", 90),
    ("zpl-2.1", r"this software is subject to the provisions of the zope public license version 2 1", "zope public", 93),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 93),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software", 92),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text", "copies of vim", 92),
    ("lppl-1.3c", r"this work may be distributed and or modified under the conditions of the latex project public license", "latex project", 90),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "you the licensee", 88),
    ("icu", r"permission is hereby granted free of charge to any person obtaining a copy .{0,60}unicode data files", "unicode data files", 92),
    ("unicode", r"unicode inc license agreement data files and software", "unicode inc", 93),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group", 93),
    ("freetype", r"portions of this software are copyright .{0,40}the freetype project", "freetype project", 92),
    ("libtiff", r"in no event shall sam leffler or silicon graphics be liable", "sam leffler", 92),
    ("intel-bsd", r"neither the name of intel corporation nor the names of its contributors may be used", "intel corporation", 91),
    ("nvidia", r"any use reproduction disclosure or distribution of this software and related documentation without an express license agreement from nvidia", "from nvidia", 92),
    ("llvm-exception", r"llvm exceptions to the apache 2 0 license", "llvm exceptions", 93),
    ("upl-1.0", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "condition set forth below", 93),
    # Source-available and proprietary
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service", 92),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use", 92),
    ("busl-1.1", r"effective on the change date or the fourth anniversary", "change date", 90),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service", 92),
    ("commons-clause", r"commons clause license condition", "commons clause", 92),
    ("polyform-noncommercial-1.0.0", r"polyform noncommercial license 1 0 0", "polyform noncommercial", 93),
    ("polyform-small-business-1.0.0", r"polyform small business license 1 0 0", "polyform small", 93),
    ("confluent-community-1.0", r"confluent community license", "confluent community", 90),
    ("parity-7.0.0", r"the parity public license 7 0 0", "parity public", 92),
    ("rail", r"open ?rail(?: [ms])? licen[cs]e|responsible ai licen[cs]e", "rail|responsible ai", 86),
    ("llama-community", r"llama [0-9](?: [0-9])? community license agreement", "community license agreement", 92),
    ("non-commercial", r"for non ?commercial (?:use|purposes) only", "commercial", 52),
    ("evaluation", r"for evaluation (?:use|purposes) only", "evaluation", 52),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 40),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software)", "unauthori", 48),
    ("proprietary", r"this software is the (?:confidential and )?proprietary (?:property|information) of", "proprietary", 46),
    ("proprietary", r"may not be reproduced .{0,60}without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", "may not be reproduced", 47),
    ("eula", r"end user licen[cs]e agreement", "end user licen", 44),
    ("trade-secret", r"contains (?:valuable )?trade secrets", "trade secrets", 42),
    ("patent-pending", r"patents? pending", "pending", 15),
    # Notices
    ("reserved", r"all rights reserved", "rights reserved", 20),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 10),
    ("spdx-none", r"spdx licen[cs]e identifier (?:none|noassertion)", "spdx", 94),
    ("dual", r"(?:dual|multi|tri) licensed under", "licensed under", 30),
    ("see-file", r"see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying) (?:file )?(?:in the project root )?for (?:full )?(?:licen[cs]e )?(?:information|details|terms)", "see ", 25),
    ("see-file", r"licen[cs]e that can be found in the licen[cs]e file", "can be found in", 35),
    ("bsd", r"use of this source code is governed by a bsd style licen[cs]e", "bsd style", 87),
    ("mit", r"use of this source code is governed by an mit style licen[cs]e", "mit style", 87),
)
