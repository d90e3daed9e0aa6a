x164