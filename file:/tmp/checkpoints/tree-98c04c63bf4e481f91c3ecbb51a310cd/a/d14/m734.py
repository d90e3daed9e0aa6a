x734