"""Licence templates: names, titles, standard headers and short full texts, by SPDX identifier.

Fixed values: the published wording of the licences, without copyright lines.  Long licences are
known by their title and their standard file header.  Statements and tags are made by rule.
"""

from __future__ import annotations

_AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_NOTICE = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_APACHE_FOUNDATION = 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"


def _gnu(kind: str, version: str, what: str = "program") -> list[str]:
    """The usual file header of a GNU licence, as a whole and by its paragraphs that name it."""
    name = f"GNU {kind}General Public License"
    first = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    second = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    third = f"You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    return [first, f"{first} {second} {third}"]


#: identifier: (other identifiers, names, texts)
LICENCES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "0BSD": ((), ("Zero-Clause BSD License",), (f"{_ISC_GRANT}. {_ISC_AS_IS}",)),
    "AGPL-3.0": (("AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License, version 3",), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero ", "3"))),
    "Apache-2.0": ((), ("Apache License, Version 2.0",), ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE, _APACHE_FOUNDATION)),
    "BSD-2-Clause": ((), ("BSD 2-Clause License", "Simplified BSD License"), (f"{_BSD_OPEN} {_BSD_1} {_BSD_2} {_BSD_AS_IS}",)),
    "BSD-3-Clause": ((), ("BSD 3-Clause License", "New BSD License"), (f"{_BSD_OPEN} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_AS_IS}", _BSD_3)),
    "BSL-1.0": ((), ("Boost Software License, Version 1.0",), ("Boost Software License - Version 1.0 - August 17th, 2003", _BOOST)),
    "CC-BY-4.0": ((), ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), ("Creative Commons Attribution 4.0 International Public License",)),
    "CC-BY-NC-4.0": ((), ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("Creative Commons Attribution-NonCommercial 4.0 International Public License",)),
    "CC-BY-SA-4.0": ((), ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("Creative Commons Attribution-ShareAlike 4.0 International Public License",)),
    "CC0-1.0": ((), ("CC0 1.0", "CC0 1.0 Universal"), ("Creative Commons Legal Code CC0 1.0 Universal", "Released into the public domain under CC0 1.0.")),
    "EPL-2.0": ((), ("Eclipse Public License 2.0",), ("Eclipse Public License - v 2.0", _EPL)),
    "GPL-2.0": (("GPL-2.0-only", "GPL-2.0-or-later"), ("GNU General Public License, version 2",), ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("", "2"))),
    "GPL-3.0": (("GPL-3.0-only", "GPL-3.0-or-later"), ("GNU General Public License, version 3",), ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("", "3"))),
    "ISC": ((), ("ISC License",), (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.")),
    "LGPL-2.1": (("LGPL-2.1-only", "LGPL-2.1-or-later"), ("GNU Lesser General Public License, version 2.1",), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("Lesser ", "2.1", "library"))),
    "LGPL-3.0": (("LGPL-3.0-only", "LGPL-3.0-or-later"), ("GNU Lesser General Public License, version 3",), ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("Lesser ", "3"))),
    "MIT": (("X11",), ("MIT License", "MIT/X11 License"), (f"{_MIT_GRANT}, {_MIT_NOTICE} {_AS_IS_MIT}", f"{_MIT_GRANT}, subject to the following conditions:")),
    "MIT-0": ((), ("MIT No Attribution License",), (f"{_MIT_GRANT}. {_AS_IS_MIT}",)),
    "MPL-2.0": ((), ("Mozilla Public License, version 2.0",), ("Mozilla Public License Version 2.0", _MPL)),
    "Unlicense": ((), ("Unlicense",), (_UNLICENSE, "This is free and unencumbered software released into the public domain.")),
    "Zlib": ((), ("zlib License",), (_ZLIB,)),
}

_STATEMENTS = "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This source code is governed by the {} license that can be found in the LICENSE file"


def forms(licences: dict = LICENCES) -> dict[str, list[str]]:
    """All texts that stand for a licence: its tags, statements by name, titles, headers and full texts."""
    out = {}
    for name, (others, names, texts) in licences.items():
        tags = [f"SPDX-License-Identifier: {x}" for x in (name, *others)]
        out[name] = [*tags, *(s.format(n) for n in names for s in _STATEMENTS), *texts]
    return out
