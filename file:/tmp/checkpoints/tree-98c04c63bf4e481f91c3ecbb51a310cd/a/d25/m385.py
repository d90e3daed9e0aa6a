x385