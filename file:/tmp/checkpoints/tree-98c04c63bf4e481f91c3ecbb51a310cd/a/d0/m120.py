x120