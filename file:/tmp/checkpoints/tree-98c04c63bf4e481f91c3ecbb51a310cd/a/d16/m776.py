x776