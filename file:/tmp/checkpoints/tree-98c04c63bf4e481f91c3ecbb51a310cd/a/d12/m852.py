x852