x419