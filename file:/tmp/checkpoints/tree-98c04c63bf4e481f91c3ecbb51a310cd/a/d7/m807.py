x807