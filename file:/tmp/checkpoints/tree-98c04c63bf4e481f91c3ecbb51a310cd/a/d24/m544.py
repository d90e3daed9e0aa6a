x544