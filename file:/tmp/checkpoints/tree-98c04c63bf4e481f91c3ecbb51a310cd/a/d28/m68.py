x68