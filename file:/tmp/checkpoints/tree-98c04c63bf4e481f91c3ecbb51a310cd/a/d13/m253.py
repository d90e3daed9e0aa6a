x253