x548