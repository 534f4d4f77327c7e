"""Whole licence notices and one-line statements that licence scans look for."""

from __future__ import annotations

# Label, mandatory key phrases and text of public licence notices. Words as
# scans take them: lower case, no punctuation.
_NOTICES = [
    ("mit-text", ["permission is hereby granted free of charge", "the software is provided as is"], """
permission is hereby granted free of charge to any person obtaining a copy of this software and
associated documentation files the software to deal in the software without restriction including
without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of
any kind express or implied including but not limited to the warranties of merchantability fitness
for a particular purpose and noninfringement in no event shall the authors or copyright holders be
liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("bsd-2-clause", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"], """
redistribution and use in source and binary forms with or without modification are permitted provided
that the following conditions are met redistributions of source code must retain the above copyright
notice this list of conditions and the following disclaimer redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution this software is provided by the
copyright holders and contributors as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are
disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and
on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of
such damage"""),
    ("bsd-3-clause", ["redistribution and use in source and binary forms", "neither the name of"], """
redistribution and use in source and binary forms with or without modification are permitted provided
that the following conditions are met redistributions of source code must retain the above copyright
notice this list of conditions and the following disclaimer redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission this software is provided by the copyright holders
and contributors as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
the copyright holder or contributors be liable for any direct indirect incidental special exemplary
or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out
of the use of this software even if advised of the possibility of such damage"""),
    ("isc", ["permission to use copy modify and or distribute this software", "the author disclaims all warranties"], """
permission to use copy modify and or distribute this software for any purpose with or without fee is
hereby granted provided that the above copyright notice and this permission notice appear in all
copies the software is provided as is and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness in no event shall the author
be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other
tortious action arising out of or in connection with the use or performance of this software"""),
    ("zlib", ["this software is provided as is without any express or implied warranty", "must not be misrepresented"], """
this software is provided as is without any express or implied warranty in no event will the authors
be held liable for any damages arising from the use of this software permission is granted to anyone
to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions the origin of this software must not be
misrepresented you must not claim that you wrote the original software if you use this software in a
product an acknowledgment in the product documentation would be appreciated but is not required
altered source versions must be plainly marked as such and must not be misrepresented as being the
original software this notice may not be removed or altered from any source distribution"""),
    ("apache-2.0", ["licensed under the apache license version 2 0", "distributed on an as is basis"], """
licensed under the apache license version 2 0 the license you may not use this file except in
compliance with the license you may obtain a copy of the license at http www apache org licenses
license 2 0 unless required by applicable law or agreed to in writing software distributed under the
license is distributed on an as is basis without warranties or conditions of any kind either express
or implied see the license for the specific language governing permissions and limitations under the
license"""),
    ("gpl-2.0", ["gnu general public license", "version 2 of the license"], """
this program is free software you can redistribute it and or modify it under the terms of the gnu
general public license as published by the free software foundation either version 2 of the license or
at your option any later version this program is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular
purpose see the gnu general public license for more details"""),
    ("gpl-3.0", ["gnu general public license", "version 3 of the license"], """
this program is free software you can redistribute it and or modify it under the terms of the gnu
general public license as published by the free software foundation either version 3 of the license or
at your option any later version this program is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular
purpose see the gnu general public license for more details"""),
    ("lgpl", ["gnu lesser general public license", "without any warranty"], """
this library is free software you can redistribute it and or modify it under the terms of the gnu
lesser general public license as published by the free software foundation either version 2 1 of the
license or at your option any later version this library is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu lesser general public license for more details"""),
    ("agpl-3.0", ["gnu affero general public license", "version 3 of the license"], """
this program is free software you can redistribute it and or modify it under the terms of the gnu
affero general public license as published by the free software foundation either version 3 of the
license or at your option any later version this program is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu affero general public license for more details"""),
    ("mpl-2.0", ["mozilla public license v 2 0", "a copy of the mpl"], """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl
was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("unlicense", ["free and unencumbered software released into the public domain", "dedicate any and all copyright interest"], """
this is free and unencumbered software released into the public domain anyone is free to copy modify
publish use compile sell or distribute this software either in source code form or as a compiled
binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize
copyright laws the author or authors of this software dedicate any and all copyright interest in the
software to the public domain we make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors we intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law"""),
    ("bsl-1.0", ["boost software license version 1 0", "to use reproduce display distribute"], """
boost software license version 1 0 permission is hereby granted free of charge to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license
the software to use reproduce display distribute execute and transmit the software and to prepare
derivative works of the software and to permit third parties to whom the software is furnished to do
so all subject to the following"""),
    ("cc-by-4.0", ["creative commons attribution 4 0 international license"], """
this work is licensed under a creative commons attribution 4 0 international license"""),
    ("cc-by-sa-4.0", ["creative commons attribution sharealike 4 0 international license"], """
this work is licensed under a creative commons attribution sharealike 4 0 international license"""),
    ("cc-by-nc-4.0", ["creative commons attribution noncommercial 4 0 international license"], """
this work is licensed under a creative commons attribution noncommercial 4 0 international license"""),
    ("cc0-1.0", ["cc0 1 0 universal"], """
to the extent possible under law the author has waived all copyright and related or neighboring rights
to this work under cc0 1 0 universal"""),
    ("apache-2.0", ["licensed under apache 2 0"], "licensed under apache 2 0"),
    ("apache-2.0", ["licensed under the apache 2 0 license"], "licensed under the apache 2 0 license"),
]

# Identifiers that may follow SPDX-License-Identifier.
_SPDX = """
0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0
CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib
""".split()


def _spdx(name: str) -> tuple[str, list[str], str]:
    line = "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")
    return f"spdx-{name.lower()}", [line], line


#: (label, key phrases, text) of everything that is looked for.
NOTICES = [(label, keys, " ".join(text.split())) for label, keys, text in _NOTICES] + [_spdx(n) for n in _SPDX]

#: A notice that holds another nearly whole: the longer one alone is named.
HOLDS = {"bsd-3-clause": "bsd-2-clause"}
